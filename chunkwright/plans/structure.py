"""Section, structure and chunking queries over conversations as markdown documents and decorated documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwright.functions.rewrite import RULES, column, duckdb
from chunkwright.operators import chunking as C
from chunkwright.operators import sections as X
from chunkwright.plans.corpora import DUCK_CHUNKS, DUCK_CONVERSATIONS, DUCK_DECORATED, chunks, conversations_markdown, decorated, table
from chunkwright.plans.registry import query

_SECTIONS = """lines AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}),
 placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM lines),
 heads AS (SELECT doc_id, n, CAST(start_char AS BIGINT) AS start_char, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS level, trim(regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1)) AS title, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord FROM placed WHERE regexp_matches(line, '^#{{1,6}}\\s+.+$')),
 sections AS (SELECT h.doc_id, h.ord, h.level, h.title, h.start_char, coalesce((SELECT min(m.start_char) FROM heads m WHERE m.doc_id = h.doc_id AND m.ord > h.ord AND m.level <= h.level), h.n) AS end_char,
   (SELECT max(m.ord) FROM heads m WHERE m.doc_id = h.doc_id AND m.ord < h.ord AND m.level < h.level) AS parent_ord FROM heads h)"""
_CONV = f"{DUCK_CONVERSATIONS}, {_SECTIONS.format(source='markdown')}"
_POINTS = "points AS (SELECT doc_id, unnest(range(0, 1 + length(text) // 200)) AS chunk_index, text FROM markdown)"


@query("x05_sections", f"WITH {_CONV} SELECT * FROM sections")
def sections(spark, sf_dir):
    """Flat sections with ends and parents."""
    return X.sections(conversations_markdown(spark, sf_dir))


@query("x05_sections_decorated", f"WITH {DUCK_DECORATED}, {_SECTIONS.format(source='decorated')} SELECT * FROM sections")
def sections_decorated(spark, sf_dir):
    return X.sections(decorated(spark, sf_dir))


def _points(spark, sf_dir):
    md = conversations_markdown(spark, sf_dir)
    return md.select("doc_id", F.explode(F.expr("sequence(0L, length(text) div 200)")).alias("chunk_index")).withColumn("start_char", F.col("chunk_index") * 200)


@query(
    "x06_heading_path",
    f"WITH {_CONV}, {_POINTS}, hit AS (SELECT p.doc_id, p.chunk_index, string_agg(title, ' > ' ORDER BY level, s.start_char) AS path FROM points p JOIN sections s ON s.doc_id = p.doc_id AND s.start_char <= p.chunk_index * 200 AND s.end_char >= p.chunk_index * 200 GROUP BY 1, 2) "
    "SELECT p.doc_id, p.chunk_index, coalesce(path, '') AS path FROM points p LEFT JOIN hit USING (doc_id, chunk_index)",
)
def heading_path(spark, sf_dir):
    return X.heading_paths(_points(spark, sf_dir), X.sections(conversations_markdown(spark, sf_dir)))


@query(
    "x12_structure_to_chunk",
    f"WITH {_CONV}, {_POINTS} SELECT s.doc_id, s.ord, min(p.chunk_index) AS chunk_index FROM sections s JOIN points p ON p.doc_id = s.doc_id AND p.chunk_index * 200 <= s.start_char AND p.chunk_index * 200 + 256 >= s.start_char GROUP BY 1, 2",
)
def structure_to_chunk(spark, sf_dir):
    found, points = X.sections(conversations_markdown(spark, sf_dir)).select("doc_id", "ord", F.col("start_char").alias("s")), _points(spark, sf_dir)
    hit = found.join(points, "doc_id").where("start_char <= s AND start_char + 256 >= s")
    return hit.groupBy("doc_id", "ord").agg(F.min("chunk_index").alias("chunk_index"))


@query(
    "x13_nearest_page",
    f"WITH {DUCK_CONVERSATIONS}, {_POINTS}, pages AS (SELECT doc_id, unnest([1, 2, 3]) AS page FROM markdown), d AS (SELECT p.doc_id, p.chunk_index, page, p.chunk_index * 200 AS at_char, page * 400 - 300 AS a, page * 400 - 100 AS b FROM points p JOIN pages USING (doc_id)) "
    "SELECT doc_id, chunk_index, page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY CASE WHEN a <= at_char AND at_char <= b THEN -1 ELSE least(abs(a - at_char), abs(b - at_char)) END, page) AS k FROM d) WHERE k = 1",
)
def nearest_page(spark, sf_dir):
    """Three pages of 200 characters with gaps between them."""
    md = conversations_markdown(spark, sf_dir)
    pages = md.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page")).withColumn("from_char", F.col("page") * 400 - 300).withColumn("to_char", F.col("page") * 400 - 100)
    return X.page_of(_points(spark, sf_dir), pages)


_FENCED = "```(\\w+)?\\s*\\n([\\s\\S]*?)```"
_TICKS = "replace(text, 'x = 1', 'x = `1`')"
_SUM = lambda x: f"coalesce(list_sum(list_transform({x}, lambda p: length(p))), 0)"


@query(
    "x01_code_blocks",
    f"WITH {DUCK_DECORATED}, t AS (SELECT doc_id, {_TICKS} AS text FROM decorated), f AS (SELECT doc_id, string_split_regex(text, '{_FENCED}') AS gaps, regexp_extract_all(text, '{_FENCED}', 0) AS whole, regexp_extract_all(text, '{_FENCED}', 1) AS l, regexp_extract_all(text, '{_FENCED}', 2) AS b FROM t) "
    f"SELECT doc_id, k - 1 AS k, coalesce(nullif(l[k], ''), 'text') AS language, trim(b[k], ' ' || chr(10)) AS body, CAST({_SUM('gaps[1:k]')} + {_SUM('whole[1:k - 1]')} AS BIGINT) AS start_char, CAST({_SUM('gaps[1:k]')} + {_SUM('whole[1:k]')} AS BIGINT) AS end_char FROM (SELECT *, unnest(range(1, len(b) + 1)) AS k FROM f)",
)
def code_blocks(spark, sf_dir):
    """Fenced blocks with language, body and place; what stands between matches gives the offsets."""
    t = decorated(spark, sf_dir).select("doc_id", F.expr(_TICKS).alias("text"))
    every = lambda g: F.regexp_extract_all("text", F.lit(_FENCED), F.lit(g))
    f = t.select("doc_id", F.split("text", _FENCED, -1).alias("gaps"), every(0).alias("whole"), F.arrays_zip(every(1).alias("l"), every(2).alias("b")).alias("both"))
    f = f.select("doc_id", "gaps", "whole", F.posexplode("both").alias("k", "x"))
    total = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda a, p: a + F.length(p))
    k = F.col("k")
    start = total("gaps", k + 1) + total("whole", k)
    return f.select(
        "doc_id", "k", F.coalesce(F.nullif(F.col("x.l"), F.lit("")), F.lit("text")).alias("language"), F.btrim(F.col("x.b"), F.lit(" \n")).alias("body"),
        start.cast("long").alias("start_char"), (start + F.length(F.get("whole", k))).cast("long").alias("end_char"),
    )


@query(
    "x02_tables",
    f"WITH {DUCK_DECORATED}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^\\|.+\\|\\n\\|[-:\\s|]+\\|\\n(?:\\|.+\\|(?:\\n|\\z))+')) AS t FROM decorated) SELECT doc_id, string_split(t, chr(10))[1] AS header, len(list_filter(string_split(t, chr(10)), lambda x: x <> '')) - 2 AS n_rows, count(*) AS n FROM t GROUP BY 1, 2, 3",
)
def tables(spark, sf_dir):
    t = decorated(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?dm)^\|.+\|\n\|[-:\s|]+\|\n(?:\|.+\|(?:\n|\z))+"), F.lit(0))).alias("t"))
    rows = F.split("t", "\n")
    return t.select("doc_id", rows[0].alias("header"), (F.size(F.filter(rows, lambda x: x != "")) - 2).alias("n_rows")).groupBy("doc_id", "header", "n_rows").agg(F.count("*").alias("n"))


_TABLE = "^\\|.+\\|\\n\\|[-:\\s|]+\\|\\n(?:\\|.+\\|(?:\\n|\\z))+"
_CELLS = lambda x: f"list_transform(list_filter(string_split({x}, '|'), lambda c: c <> ''), lambda c: trim(c, ' ' || chr(9) || chr(13)))"


@query(
    "x02_table_rows",
    f"WITH {DUCK_DECORATED}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m){_TABLE}')) AS t, generate_subscripts(regexp_extract_all(text, '(?m){_TABLE}'), 1) - 1 AS k FROM decorated), l AS (SELECT doc_id, k, list_filter(string_split(t, chr(10)), lambda x: x <> '') AS l FROM t), "
    f"r AS (SELECT doc_id, k, {_CELLS('l[1]')} AS h, unnest(l[3:]) AS line, generate_subscripts(l[3:], 1) - 1 AS i FROM l), c AS (SELECT *, {_CELLS('line')} AS c FROM r), z AS (SELECT doc_id, k, i, list_zip(h[1:least(len(h), len(c))], c[1:least(len(h), len(c))]) AS z FROM c) "
    "SELECT doc_id, k, i, array_to_string(list_transform(list_filter(z, lambda e, j: NOT list_contains(list_transform(z[j + 1:], lambda y: y[1]), e[1])), lambda e: e[1] || '=' || e[2]), ';') AS cells FROM z",
)
def table_rows(spark, sf_dir):
    """A row for each table row, its cells by header as far as both go; of equal headers the last counts."""
    t = decorated(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?dm)" + _TABLE), F.lit(0))).alias("k", "t"))
    cells = lambda x: F.transform(F.filter(F.split(x, r"\|"), lambda c: c != ""), lambda c: F.btrim(c, F.lit(" \t\r")))
    lines = t.select("doc_id", "k", F.filter(F.split("t", "\n"), lambda x: x != "").alias("l"))
    rows = lines.select("doc_id", "k", cells(F.get("l", F.lit(0))).alias("h"), F.posexplode(F.slice("l", 3, F.size("l"))).alias("i", "line")).withColumn("c", cells(F.col("line")))
    n = F.least(F.size("h"), F.size("c"))
    both = rows.select("doc_id", "k", "i", F.zip_with(F.slice("h", 1, n), F.slice("c", 1, n), lambda h, c: F.struct(h.alias("h"), c.alias("c"))).alias("z"))
    last = F.filter("z", lambda e, j: ~F.array_contains(F.transform(F.slice("z", j + 2, F.size("z")), lambda y: y["h"]), e["h"]))
    return both.select("doc_id", "k", "i", F.array_join(F.transform(last, lambda e: F.concat(e["h"], F.lit("="), e["c"])), ";").alias("cells"))


#: Headings of two levels between the markers that chunkers leave.
_MARKED = [(f"^{'#' * k} (.*)$", f"<!-- HEADING_START:H{k} -->{'#' * k} {{}}<!-- HEADING_END:H{k} -->") for k in (2, 4)]
_LEVEL = "<!--\\s*HEADING_START:H(\\d+)\\s*-->"


@query(
    "x15_heading_levels",
    f"WITH {DUCK_DECORATED}, m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m){_MARKED[0][0]}', '{_MARKED[0][1].format(chr(92) + '1')}', 'g'), '(?m){_MARKED[1][0]}', '{_MARKED[1][1].format(chr(92) + '1')}', 'g') AS text FROM decorated), "
    "p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS i FROM m) "
    f"SELECT doc_id, i, TRY_CAST(regexp_extract(part, '{_LEVEL}', 1) AS INT) AS level, md5({duckdb('part', RULES['strip_markers'])}) AS digest FROM p",
)
def heading_levels(spark, sf_dir):
    """The level of a chunk's first heading marker is lifted before the markers are stripped; null without one."""
    text = F.col("text")
    for pattern, to in _MARKED:
        text = F.regexp_replace(text, "(?dm)" + pattern, to.format("$1"))
    parts = decorated(spark, sf_dir).select("doc_id", F.posexplode(F.split(text, "\n\n")).alias("i", "part"))
    return parts.select("doc_id", "i", F.expr(f"try_cast(regexp_extract(part, '{_LEVEL.replace(chr(92), chr(92) * 2)}', 1) AS int)").alias("level"), F.md5(column(F.col("part"), RULES["strip_markers"])).alias("digest"))


@query("c05_token_windows", f"WITH {DUCK_CHUNKS} SELECT doc_id, chunk_index, length(content) AS n_chars, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, md5(content) AS digest FROM chunks")
def token_windows(spark, sf_dir):
    """Windows with overlap and their token estimate."""
    return chunks(spark, sf_dir).select("doc_id", "chunk_index", F.length("content").alias("n_chars"), F.ceil(F.length("content") / 4.0).alias("tokens"), F.md5("content").alias("digest"))


@query(
    "c17_sentences",
    "WITH m AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?。！？])', '\\1' || chr(1), 'g'), chr(1) || '(\\p{Nd}|\\p{Ll})', '\\1', 'g'), chr(1)), lambda s: s <> '') AS s FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM m",
)
def sentences(spark, sf_dir):
    s = C.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("c04_paragraphs", f"WITH {DUCK_DECORATED} SELECT doc_id, i, p FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda p: p <> '') AS l FROM decorated))")
def paragraphs(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", F.posexplode(C.paragraphs(F.col("text"))).alias("i", "p"))


#: Every fifth document begins with a long paragraph without letters' cases, so that sentences end before Han.
_LONG = "CASE WHEN doc_id % 5 = 0 THEN repeat('这是中文句子。', 400) || chr(10) || chr(10) ELSE '' END || text"
_PARTS = "list_filter(string_split_regex(text, '\\r\\n\\r\\n|\\n\\n'), lambda p: p <> '')"
_PIECES = "list_filter(string_split(regexp_replace(regexp_replace(part, '([.!?。！？])', '\\1' || chr(1), 'g'), chr(1) || '(\\p{Nd}|\\p{Ll})', '\\1', 'g'), chr(1)), lambda s: s <> '')"
_JOINS = "r.p = u.p AND r.n + length(u.t) + CASE WHEN u.p = 0 THEN 2 ELSE 0 END <= 1600 AND length(u.t) <= 1600"


@query(
    "c16_packed",
    f"""WITH RECURSIVE {DUCK_DECORATED}, d AS (SELECT doc_id, {_LONG} AS text FROM decorated), par AS (SELECT doc_id, unnest({_PARTS}) AS part, generate_subscripts({_PARTS}, 1) AS i FROM d WHERE length(text) > 1600),
    un AS (SELECT doc_id, i, 0 AS j, 0 AS p, part AS t FROM par WHERE length(part) <= 1600 UNION ALL SELECT doc_id, i, generate_subscripts({_PIECES}, 1) AS j, i AS p, unnest({_PIECES}) AS t FROM par WHERE length(part) > 1600),
    u AS (SELECT doc_id, p, t, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM un),
    r AS (SELECT doc_id, k, p, length(t) AS n, k AS seg FROM u WHERE k = 1 UNION ALL
      SELECT u.doc_id, u.k, u.p, CASE WHEN {_JOINS} THEN r.n + length(u.t) + CASE WHEN u.p = 0 THEN 2 ELSE 0 END ELSE length(u.t) END, CASE WHEN {_JOINS} THEN r.seg ELSE u.k END FROM r JOIN u ON u.doc_id = r.doc_id AND u.k = r.k + 1),
    g AS (SELECT doc_id, seg, min(p) AS p, max(length(t)) AS longest, string_agg(t, '' ORDER BY k) AS run, string_agg(t, chr(10) || chr(10) ORDER BY k) AS block FROM r JOIN u USING (doc_id, k, p) GROUP BY doc_id, seg),
    c AS (SELECT doc_id, seg, regexp_replace(CASE WHEN p = 0 THEN block WHEN longest > 1600 THEN left(run, 1550) || '...' ELSE run END, '\\A[{C.WHITE}]+|[{C.WHITE}]+\\z', '', 'g') AS content FROM g)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS chunk_index, content FROM c WHERE length(content) > 50
    UNION ALL SELECT doc_id, 0 AS chunk_index, text AS content FROM d WHERE length(text) <= 1600 AND regexp_replace(text, '\\A[{C.WHITE}]+', '') <> ''""",
)
def packed(spark, sf_dir):
    """Greedy packing of paragraphs and sentences."""
    return C.pack(decorated(spark, sf_dir).select("doc_id", F.expr(_LONG.replace("chr(10)", "'\\n'")).alias("text")))


_STATS = """SELECT doc_id, len(regexp_extract_all(t, '(?m)^#{{1,6}}\\s+')) AS headings, len(regexp_extract_all(t, '(?m)^\\d+[.)]\\s+')) AS numbered,
 coalesce(list_avg(list_transform(list_filter(string_split(t, chr(10) || chr(10)), lambda p: length(p) > 20), lambda p: length(p))), 0e0) AS paragraph FROM (SELECT doc_id, substr(text, 1, 10000) AS t FROM decorated)"""


@query(
    "c02_strategy",
    f"WITH {DUCK_DECORATED}, s AS ({_STATS.format()}) SELECT doc_id, headings, numbered, round(paragraph, 6) AS paragraph, CASE WHEN headings >= 3 THEN 'Hierarchical' WHEN numbered >= 5 OR paragraph > 300 THEN 'Paragraph' ELSE 'Sentence' END AS strategy FROM s",
)
def strategy(spark, sf_dir):
    """Structure of the first 10 000 characters and the chunker it calls for (the rule reads no more)."""
    t = F.substring("text", 1, 10_000)
    long_ones = F.filter(F.split(t, "\n\n"), lambda p: F.length(p) > 20)
    s = decorated(spark, sf_dir).select(
        "doc_id", F.size(F.regexp_extract_all(t, F.lit(r"(?dm)^#{1,6}\s+"), F.lit(0))).alias("headings"), F.size(F.regexp_extract_all(t, F.lit(r"(?dm)^\d+[.)]\s+"), F.lit(0))).alias("numbered"),
        F.when(F.size(long_ones) > 0, F.aggregate(long_ones, F.lit(0), lambda a, p: a + F.length(p)) / F.size(long_ones)).otherwise(0.0).alias("paragraph"),
    )
    kind = F.when(F.col("headings") >= 3, "Hierarchical").when((F.col("numbered") >= 5) | (F.col("paragraph") > 300), "Paragraph").otherwise("Sentence")
    return s.select("doc_id", "headings", "numbered", F.round("paragraph", 6).alias("paragraph"), kind.alias("strategy"))
