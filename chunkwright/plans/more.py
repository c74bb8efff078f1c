"""Further rules: descriptions, merges, JSON answers, adaptive thresholds, list indents, semantic chunks, model hooks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chunkwright.functions import models
from chunkwright.functions import scores as S
from chunkwright.functions.arrays import kept_by
from chunkwright.operators import enrichment as N
from chunkwright.plans.corpora import DUCK_CONVERSATIONS, DUCK_DECORATED, conversations_markdown, decorated, table
from chunkwright.plans.registry import query

_B = "' ' || chr(9) || chr(13) || chr(10)"
_PARA = f"list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p, {_B})), lambda p: length(p) > 50 AND length(p) < 300 AND NOT starts_with(p, '#') AND NOT regexp_matches(p, '^[\\d.)]+\\s'))"
_FIRST = f"string_split(regexp_replace({_PARA}[1], '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1]"


@query("d06_description", f"SELECT doc_id, CASE WHEN length({_FIRST}) > 200 THEN substr({_FIRST}, 1, 200) || '...' WHEN length({_FIRST}) > 20 THEN {_FIRST} ELSE '' END AS description FROM documents WHERE text IS NOT NULL")
def description(spark, sf_dir):
    """The first sentence of the first paragraph of middling length; a line is a paragraph here."""
    parts = F.filter(F.transform(F.split("text", "\n"), S.trimmed), lambda p: (F.length(p) > 50) & (F.length(p) < 300) & ~p.startswith("#") & ~p.rlike(r"^[\d.)]+\s"))
    first = F.split(F.regexp_replace(F.try_element_at(parts, F.lit(1)), r"([.!?])\s+", "$1\x01"), "\x01")[0]
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", first.alias("f"))
    return d.select("doc_id", F.when(F.length("f") > 200, F.concat(F.substring("f", 1, 200), F.lit("..."))).when(F.length("f") > 20, F.col("f")).otherwise("").alias("description"))


_FIRST_LINE = "substr(string_split(text, chr(10))[1], 1, 80)"
_PARTS = "regexp_extract(text, '^[^.!?\\n]*')"


@query(
    "d09_merged_metadata",
    f"""WITH t AS (SELECT doc_id, text, length(text) AS n, lang FROM documents WHERE text IS NOT NULL),
    m AS (SELECT doc_id, n, least(1e0, n / 1000e0) AS sure, {_FIRST_LINE} AS rule_title, coalesce(lang, '') AS rule_language, CASE WHEN {_PARTS} <> '' THEN substr({_PARTS}, 1, 60) END AS said_title, CAST(len(string_split(text, chr(10))) AS VARCHAR) AS said_lines,
      CASE WHEN trim({_FIRST_LINE}) <> '' THEN 1e0 ELSE 0e0 END AS rule_sure FROM t)
    SELECT doc_id, CASE WHEN n < 50 THEN 'rules' WHEN sure >= 0.6 THEN 'ai' ELSE 'hybrid' END AS method, round(CASE WHEN n < 50 THEN rule_sure WHEN sure >= 0.6 THEN sure ELSE (sure + rule_sure) / 2 END, 9) AS confidence,
      CASE WHEN n < 50 THEN rule_title WHEN sure >= 0.6 THEN said_title ELSE coalesce(said_title, rule_title) END AS title, CASE WHEN n < 50 OR sure < 0.6 THEN rule_language END AS language, CASE WHEN n >= 50 THEN said_lines END AS lines FROM m""",
)
def merged_metadata(spark, sf_dir):
    """Each distinct text is asked once; unsure answers are filled up from the rules (first line, declared language), failed ones replaced by them."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", "lang")
    first = F.substring(F.split("text", "\n")[0], 1, 80)
    rules = F.create_map(F.lit("title"), first, F.lit("language"), F.coalesce("lang", F.lit("")))
    found = N.enrich(docs, rules, F.when(F.trim(first) != "", 1.0).otherwise(0.0))
    field = lambda name: F.try_element_at("fields", F.lit(name)).alias(name)
    return found.select("doc_id", "method", F.round("confidence", 9).alias("confidence"), field("title"), field("language"), field("lines"))


_ANSWER = """CASE doc_id % 3 WHEN 0 THEN 'Sure: {"title": "T' || doc_id || '", "pages": ' || doc_id || '} done' WHEN 1 THEN '{"title": "U", "pages": "x"}' ELSE 'no answer' END"""


@query(
    "d11_json_answers",
    f"WITH a AS (SELECT doc_id, regexp_extract({_ANSWER}, '(?s)\\{{.*\\}}') AS j FROM documents) SELECT doc_id, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.title') END AS title, CASE WHEN json_valid(j) THEN TRY_CAST(json_extract_string(j, '$.pages') AS BIGINT) END AS pages FROM a",
)
def json_answers(spark, sf_dir):
    """From the first brace to the last, then by path; what isn't JSON gives nulls."""
    j = F.nullif(F.regexp_extract(F.expr(_ANSWER), r"(?s)\{.*\}", 0), F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", j.alias("j"))
    return d.select("doc_id", F.get_json_object("j", "$.title").alias("title"), F.expr("try_cast(get_json_object(j, '$.pages') AS bigint)").alias("pages"))


_HEADED = "regexp_matches(text, '(?m)^\\s*#{{1,6}}\\s+.+$')".replace("{{", "{").replace("}}", "}")


@query(
    "d17_parser_quality",
    f"WITH {DUCK_DECORATED} SELECT doc_id, CASE WHEN {_HEADED} THEN 0.8e0 ELSE 0.3e0 END AS structure, CASE WHEN doc_id % 2 = 0 THEN 0.9e0 ELSE 0.6e0 END AS cleanup, round(CASE WHEN length(text) > 0 THEN least(1e0, list_sum(list_transform(string_split(text, chr(10)), lambda l: length(l))) / length(text)) ELSE 1e0 END, 9) AS retention, "
    f"CASE WHEN {_HEADED} THEN 0.8e0 ELSE 0.3e0 END AS confidence, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS word_count, greatest(1, length(text) // 3000) AS page_count FROM decorated",
)
def parser_quality(spark, sf_dir):
    """Structure by sections found, cleanup by whether a model took part (every other document), retention by what the parts hold."""
    t = F.col("text")
    structure = F.when(t.rlike(r"(?dm)^\s*#{1,6}\s+.+$"), 0.8).otherwise(0.3)
    held = F.aggregate(F.split(t, "\n"), F.lit(0), lambda a, x: a + F.length(x))
    return decorated(spark, sf_dir).select(
        "doc_id", structure.alias("structure"), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.6).alias("cleanup"), F.round(F.when(F.length(t) > 0, F.least(F.lit(1.0), held / F.length(t))).otherwise(1.0), 9).alias("retention"),
        structure.alias("confidence"), F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).alias("word_count"), F.expr("greatest(1, length(text) div 3000)").alias("page_count"),
    )


@query(
    "b06_adaptive_threshold",
    "SELECT doc_id, i, round(threshold, 6) AS threshold, long_enough FROM (SELECT conv_id AS doc_id, turn AS i, CASE WHEN (row_number() OVER w - 1) / n < 0.1 OR (row_number() OVER w - 1) / n > 0.9 THEN 0.7e0 * 0.8e0 ELSE 0.7e0 END AS threshold, length(text) >= 50 AS long_enough FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text))",
)
def adaptive_threshold(spark, sf_dir):
    own = Window.partitionBy("conv_id")
    place = (F.row_number().over(own.orderBy("turn", "text")) - 1) / F.count("*").over(own)
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("i"), F.round(F.when((place < 0.1) | (place > 0.9), 0.56).otherwise(0.7), 6).alias("threshold"), (F.length("text") >= 50).alias("long_enough"))


_ITEM = "^(\\s*)([-*+]|\\d+\\.)\\s+(.*)$"


@query(
    "n04_list_indents",
    f"""WITH RECURSIVE {DUCK_DECORATED}, l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, indent, fresh FROM (SELECT doc_id, i, CASE WHEN regexp_matches(line, '{_ITEM}') THEN length(regexp_extract(line, '{_ITEM}', 1)) END AS indent, trim(line, {_B}) <> '' AND NOT regexp_matches(line, '{_ITEM}') AS fresh
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM decorated)) WHERE indent IS NOT NULL OR fresh),
    r AS (SELECT doc_id, k, indent AS last, indent AS now FROM l WHERE k = 1 UNION ALL SELECT l.doc_id, l.k, CASE WHEN l.fresh THEN NULL WHEN r.last IS NULL THEN l.indent WHEN l.indent > r.last + 4 THEN r.last + 2 ELSE l.indent END,
      CASE WHEN l.fresh THEN NULL WHEN r.last IS NULL THEN l.indent WHEN l.indent > r.last + 4 THEN r.last + 2 ELSE l.indent END FROM r JOIN l ON l.doc_id = r.doc_id AND l.k = r.k + 1)
    SELECT doc_id, string_agg(CAST(now AS VARCHAR), ',' ORDER BY k) AS indents FROM r WHERE now IS NOT NULL GROUP BY doc_id""",
)
def list_indents(spark, sf_dir):
    """Indents after repair: more than four deeper than the last item's repaired one becomes two deeper; other lines start anew. A fold over the lines that count."""
    lines = F.filter(F.split("text", "\n"), lambda x: S.trimmed(x) != "")
    marks = F.transform(lines, lambda x: F.when(x.rlike(_ITEM), F.length(F.regexp_extract(x, _ITEM, 1))).otherwise(-1))

    def step(a, x):
        now = F.when((a["last"] >= 0) & (x > a["last"] + 4), a["last"] + 2).otherwise(x)
        return {"last": F.when(x < 0, -1).otherwise(now)}, x >= 0, now

    d = decorated(spark, sf_dir).select("doc_id", kept_by(marks, {"last": F.lit(-1)}, step, "int").alias("o"))
    return d.where("size(o) > 0").select("doc_id", F.array_join(F.col("o").cast("array<string>"), ",").alias("indents"))


@query(
    "c07_semantic_chunks",
    """WITH s AS (SELECT label AS doc_id, vec_id, coalesce(list_cosine_similarity(embedding::DOUBLE[], (lag(embedding) OVER (PARTITION BY label ORDER BY vec_id))::DOUBLE[]) < 0.7, false) AS cut FROM embeddings), c AS (SELECT doc_id, vec_id, sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id ORDER BY vec_id) AS chunk_index FROM s)
    SELECT doc_id, chunk_index, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM c GROUP BY doc_id, chunk_index""",
)
def semantic_chunks(spark, sf_dir):
    """A running count of boundaries, where similarity falls under 0.7, numbers the chunks."""
    from chunkwright.operators.ordered import running_sum
    from chunkwright.operators.vectors import neighbour_similarity

    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("i"), "embedding")
    cuts = neighbour_similarity(e).where("similarity < 0.7").select("doc_id", "i")
    # a cut after a segment counts from the next one on
    marked = e.select("doc_id", "i").join(cuts.withColumn("cut", F.lit(1)), ["doc_id", "i"], "left").select("doc_id", "i", F.coalesce("cut", F.lit(0)).alias("cut"))
    c = running_sum(marked, "doc_id", "i", "cut").withColumn("chunk_index", F.col("total") - F.col("cut"))
    return c.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n"), F.min("i").alias("first_id"), F.max("i").alias("last_id"))


_ITEMS = "regexp_replace(text, '(?m)^- (.*)$', '- \\1' || chr(10) || '- \\1 again' || chr(10) || '  * below' || chr(10) || '1. last', 'g')"


@query("x03_lists", f"WITH {DUCK_DECORATED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM (SELECT doc_id, {_ITEMS} AS text FROM decorated)), r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l WHERE regexp_matches(line, '{_ITEM}')) SELECT doc_id, min(i) - 1 AS first_line, count(*) AS n_items, bool_and(regexp_matches(line, '^\\s*\\d+\\.')) AS ordered, string_agg(trim(regexp_extract(line, '{_ITEM}', 3), {_B}), '|' ORDER BY i) AS items FROM r GROUP BY doc_id, island HAVING count(*) >= 3")
def lists(spark, sf_dir):
    """Runs of three list items or more; every fourth line is followed by four items, so that there are some."""
    planted = F.regexp_replace("text", "(?dm)^- (.*)$", "- $1\n- $1 again\n  * below\n1. last")
    lines = decorated(spark, sf_dir).select("doc_id", F.posexplode(F.split(planted, "\n")).alias("i", "line")).where(F.col("line").rlike(_ITEM))
    rows = lines.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("doc_id").orderBy("i")))
    items = F.array_join(F.array_sort(F.collect_list(F.struct("i", S.trimmed(F.regexp_extract("line", _ITEM, 3)).alias("t"))))["t"], "|")
    return rows.groupBy("doc_id", "island").agg(F.min("i").alias("first_line"), F.count("*").alias("n_items"), F.every(F.col("line").rlike(r"^\s*\d+\.")).alias("ordered"), items.alias("items")).where("n_items >= 3").drop("island")


@query("x10_paragraph_offsets", f"WITH {DUCK_DECORATED}, p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS i FROM decorated) SELECT doc_id, i, CAST(coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, length(part) AS n_chars FROM p")
def paragraph_offsets(spark, sf_dir):
    """Offsets are running sums of lengths."""
    p = decorated(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("i", "part"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return p.select("doc_id", "i", F.coalesce(F.sum(F.length("part") + 2).over(before), F.lit(0)).alias("start_char"), F.length("part").alias("n_chars"))


@query("r14_image_texts", "WITH t AS (SELECT doc_id, 'See ![x](embedded:img_1) and ![y](embedded:img_2). ' || text AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, replace(replace(text, '![x](embedded:img_1)', '[Image Content: chart ' || doc_id % 5 || ']'), '![y](embedded:img_2)', '[Image Content: photo]') AS text FROM t")
def image_texts(spark, sf_dir):
    """Captions of a document's images put in place of their links; a fold over the images joined to it."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("See ![x](embedded:img_1) and ![y](embedded:img_2). "), "text").alias("text"))
    images = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("![x](embedded:img_1)").alias("link"), F.concat(F.lit("chart "), (F.col("doc_id") % 5).cast("string")).alias("caption")), F.struct(F.lit("![y](embedded:img_2)").alias("link"), F.lit("photo").alias("caption")))).alias("x")).select("doc_id", "x.*")
    lots = images.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("link", "caption"))).alias("images"))
    done = F.aggregate("images", F.col("text"), lambda t, x: F.replace(t, x["link"], F.concat(F.lit("[Image Content: "), x["caption"], F.lit("]"))))
    return docs.join(lots, "doc_id", "left").select("doc_id", F.coalesce(done, "text").alias("text"))


@query("v02_hashed_embeddings")
def hashed_embeddings(spark, sf_dir):
    """V02, U02 with the offline default."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", models.embed(F.col("text")).alias("embedding"))


@query("u01_model_hooks")
def model_hooks(spark, sf_dir):
    """Summaries and questions from pluggable callables; a failing text gives null."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", models.summarise(t).alias("summary"), models.questions(t).alias("questions"))


_SUMMARY = "substr(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '([.!?])\\s', '\\1' || chr(1), 'g'), chr(1))[1], 1, 200)"


@query("u09_conditional_enrichment", f"WITH d AS (SELECT d.doc_id, d.text, CAST(max(l.quality) AS DOUBLE) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id, d.text) SELECT doc_id, length(text) >= 500 AND coalesce(quality, 0) < 0.8 AS enriched, CASE WHEN length(text) >= 500 AND coalesce(quality, 0) < 0.8 THEN {_SUMMARY} END AS summary FROM d")
def conditional_enrichment(spark, sf_dir):
    """Texts of 500 characters or more whose quality isn't 0.8 yet. The filter stands before the model, so only they reach Python."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct()
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    judged = docs.join(quality, "doc_id", "left").withColumn("wanted", (F.length("text") >= 500) & (F.coalesce("quality", F.lit(0.0)) < 0.8))
    done = judged.where("wanted").select("doc_id", F.lit(True).alias("enriched"), models.summarise(F.col("text")).alias("summary"))
    return done.unionByName(judged.where("NOT wanted").select("doc_id", F.lit(False).alias("enriched"), F.lit(None).cast("string").alias("summary")))
