"""Text refinement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwright.functions import lines as L
from chunkwright.functions.rewrite import RULES, column, duckdb
from chunkwright.plans.corpora import DUCK_DECORATED, decorated, table
from chunkwright.plans.registry import query

_BY_RULE = {
    "r01_clean_noise": "clean_noise",
    "r02_normalize_whitespace": "normalize_whitespace",
    "r03_numbered_headings": "numbered_to_headings",
    "r07_paragraph_headings": "drop_paragraph_headings",
    "r08_image_placeholders": "drop_image_placeholders",
    "r12_contents_leaders": "drop_contents_leaders",
    "s15_strip_embedded_images": "strip_embedded_images",
    "s16_strip_control_characters": "strip_control_characters",
    "x15_strip_markers": "strip_markers",
    "m03_bullets": "bullets_to_markdown",
    "m05_image_links": "image_placeholders_to_markdown",
    "m06_markdown_spacing": "markdown_spacing",
}


def _register_rule(name: str, rule: str) -> None:
    @query(name, f"WITH {DUCK_DECORATED} SELECT doc_id, {duckdb('text', RULES[rule])} AS text FROM decorated")
    def run(spark, sf_dir):
        return decorated(spark, sf_dir).select("doc_id", column(F.col("text"), RULES[rule]).alias("text"))


for _name, _rule in _BY_RULE.items():
    _register_rule(_name, _rule)


@query("s07a_html_to_markdown", f"SELECT page_id, {duckdb('html', RULES['html_to_markdown'])} AS text FROM pages")
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", column(F.col("html"), RULES["html_to_markdown"]).alias("text"))


def _register_lines(name: str, rule: L.LineRule) -> None:
    @query(name, f"WITH {DUCK_DECORATED} SELECT doc_id, {rule.duckdb('text')} AS text FROM decorated")
    def run(spark, sf_dir):
        return decorated(spark, sf_dir).select("doc_id", rule.column(F.col("text")).alias("text"))


for _name, _line_rule in {
    "r09_clean_lines": L.CLEAN_LINES,
    "r10_drop_page_furniture": L.DROP_FURNITURE,
    "r11_drop_page_numbers": L.DROP_PAGE_NUMBERS,
    "n01_demote_annotations": L.DEMOTE_ANNOTATIONS,
    "n02_drop_empty_headings": L.DROP_EMPTY_HEADINGS,
    "r15_distinct_lines": L.DISTINCT_LINES,
}.items():
    _register_lines(_name, _line_rule)

_LEGACY = (RULES["drop_paragraph_headings"], RULES["drop_image_placeholders"], L.CLEAN_LINES, L.DROP_FURNITURE, L.DROP_PAGE_NUMBERS, RULES["drop_contents_leaders"])


def _both(parts) -> str:
    sql = "text"
    for part in parts:
        sql = part.duckdb(sql) if isinstance(part, L.LineRule) else duckdb(sql, part)
    return sql


def _composed(parts):
    col = F.col("text")
    for part in parts:
        col = part.column(col) if isinstance(part, L.LineRule) else column(col, part)
    return col


@query("r16_batch_refinement", f"WITH {DUCK_DECORATED} SELECT doc_id, {_both(_LEGACY)} AS text FROM decorated")
def batch_refinement(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", _composed(_LEGACY).alias("text"))


_STATEFUL = (RULES["clean_noise"], RULES["numbered_to_headings"], L.DEMOTE_ANNOTATIONS, L.DROP_EMPTY_HEADINGS, RULES["normalize_whitespace"])


@query("r17_staged_refinement", f"WITH {DUCK_DECORATED} SELECT doc_id, {_both(_STATEFUL)} AS text FROM decorated")
def staged_refinement(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", _composed(_STATEFUL).alias("text"))


_SCORES = """SELECT doc_id, structure, cleanup, retention, 0.75e0 AS confidence, round((structure + cleanup + retention + 0.75e0) / 4, 6) AS overall FROM (
 SELECT doc_id, CASE WHEN structures > 0 AND sections > 0 THEN 0.9e0 WHEN structures > 0 OR sections > 0 THEN 0.7e0 ELSE 0.5e0 END AS structure,
  CASE WHEN a = 0 THEN 1.0e0 WHEN 1 - b / a >= 0.05e0 AND 1 - b / a <= 0.2e0 THEN 0.9e0 WHEN 1 - b / a >= 0 AND 1 - b / a < 0.05e0 THEN 0.8e0 WHEN 1 - b / a > 0.2e0 AND 1 - b / a <= 0.35e0 THEN 0.7e0 ELSE 0.5e0 END AS cleanup,
  round(CASE WHEN a = 0 THEN 1.0e0 ELSE least(1.0e0, b / a) END, 9) AS retention FROM {source})"""


@query(
    "r19_refinement_scores",
    f"WITH {DUCK_DECORATED}, measured AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS a, CAST(length(after) AS DOUBLE) AS b, len(regexp_extract_all(text, '```')) AS structures, "
    f"len(regexp_extract_all(text, '(?m)^#{{1,6}} ')) AS sections FROM (SELECT doc_id, text, {duckdb('text', RULES['clean_noise'])} AS after FROM decorated)) "
    + _SCORES.format(source="measured"),
)
def refinement_scores(spark, sf_dir):
    after = F.length(column(F.col("text"), RULES["clean_noise"])).cast("double")
    measured = decorated(spark, sf_dir).select(
        "doc_id", F.length("text").cast("double").alias("a"), after.alias("b"), F.size(F.regexp_extract_all("text", F.lit("```"), F.lit(0))).alias("structures"),
        F.size(F.regexp_extract_all("text", F.lit("(?dm)^#{1,6} "), F.lit(0))).alias("sections"),
    )
    return spark.sql(_SCORES.format(source="{measured}"), measured=measured)


@query("r06_page_estimate", "SELECT doc_id, greatest(1, length(text) // 3000) AS pages FROM documents")
def page_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("greatest(1, length(text) div 3000)").alias("pages"))


_NORMAL = duckdb("line", RULES["normalize_line"])


@query(
    "r04_repeated_lines_filter",
    f"""WITH {DUCK_DECORATED}, l AS (SELECT doc_id, greatest(1, length(text) // 3000) AS pages, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM decorated),
    n AS (SELECT *, {_NORMAL} AS norm FROM l), f AS (SELECT doc_id, norm, count(*) AS k FROM n WHERE length(line) <= 200 AND norm <> '' GROUP BY 1, 2),
    k AS (SELECT n.* FROM n LEFT JOIN f ON n.doc_id = f.doc_id AND n.norm = f.norm WHERE n.norm = '' OR pages < 3 OR f.k IS NULL OR f.k < greatest(2, CAST(floor(pages * 0.5) AS BIGINT)))
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS text FROM decorated LEFT JOIN k USING (doc_id) GROUP BY doc_id""",
)
def repeated_lines_filter(spark, sf_dir):
    from chunkwright.operators.pages import drop_repeated_lines

    return drop_repeated_lines(decorated(spark, sf_dir).withColumn("pages", F.expr("greatest(1, length(text) div 3000)")))


@query(
    "r05_repeated_lines",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, greatest(2, length(text) // 3000) AS pages FROM documents),
    n AS (SELECT *, {_NORMAL} AS norm FROM l WHERE length(line) <= 200)
    SELECT doc_id, norm, count(*) AS occurrences, round(count(*) / max(pages), 6) AS ratio, count(*) / max(pages) >= 0.5 AS would_be_filtered FROM n WHERE norm <> '' GROUP BY doc_id, norm HAVING count(*) >= 2""",
)
def repeated_lines(spark, sf_dir):
    from chunkwright.operators.pages import repeated_line_report

    return repeated_line_report(table(spark, sf_dir, "documents").withColumn("pages", F.expr("greatest(2, length(text) div 3000)")))


@query(
    "n03_heading_levels",
    f"""WITH RECURSIVE {DUCK_DECORATED}, h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, level FROM (
      SELECT doc_id, i, length(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 1)) AS level FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM decorated)) WHERE level > 0),
    r AS (SELECT doc_id, k, CASE WHEN level > 2 THEN 1 ELSE level END AS level FROM h WHERE k = 1 UNION ALL SELECT h.doc_id, h.k, least(h.level, r.level + 1) FROM r JOIN h ON h.doc_id = r.doc_id AND h.k = r.k + 1)
    SELECT doc_id, string_agg(CAST(level AS VARCHAR), ',' ORDER BY k) AS levels FROM r GROUP BY doc_id""",
)
def heading_levels(spark, sf_dir):
    levels = L.heading_levels(F.col("text"))
    return decorated(spark, sf_dir).select("doc_id", levels.alias("levels")).where("size(levels) > 0").select("doc_id", F.array_join(L.repaired_levels(F.col("levels")).cast("array<string>"), ",").alias("levels"))


@query(
    "n06_blank_lines",
    f"WITH {DUCK_DECORATED} SELECT doc_id, {duckdb('text', [])} AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)[ \\t]+$', '', 'g'), '\\A\\n{{3,}}', chr(10) || chr(10)), '\\n{{3,}}\\z', chr(10) || chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS text FROM decorated)",
)
def blank_lines(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", L.few_blank_lines(F.col("text")).alias("text"))
