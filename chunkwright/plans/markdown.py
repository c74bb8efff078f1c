"""Markdown queries: conversion of lines, tables, blocks and images, and normalisation with its log."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwright.functions import lines as L
from chunkwright.functions.rewrite import RULES, duckdb
from chunkwright.operators import markdown as M
from chunkwright.plans.corpora import DUCK_DECORATED, decorated, table
from chunkwright.plans.registry import query

_B = "' ' || chr(9) || chr(13) || chr(10)"
_LINES = lambda source: f"SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {source}"
_PIPES = lambda x: f"(length({x}) - length(replace({x}, '|', '')))"

#: Lines that only the converter meets, after every line of six letters' capitals, and tables of all kinds.
_PLAIN = """replace(replace(replace(replace(text, '3-1. ', '3.1 Name ' ), 'CONFIDENTIAL', 'ALL CAPITALS-HERE 2' || chr(10) || '  • bullet' || chr(10) || '(4) four' || chr(10) || 'b) letter'),
 'Intro ....... 12', '[image: a chart]' || chr(10) || 'see [img_7] here' || chr(10) || '<!-- IMAGE_START:IMG_12 -->'), '|---|---|' || chr(10), CASE WHEN doc_id % 2 = 0 THEN '' ELSE '|---|---|' || chr(10) END)"""
_T, _LINE = "t", "line"
_NUMBER = "regexp_extract(t, '^(\\d+(?:\\.\\d+)*)', 1)"
_MARKED = "'^[(\\[]?([0-9]+|[a-zA-Z])[)\\].]\\s*(.+)$'"
_INDENT = "repeat(' ', length(line) - length(ltrim(line, ' ')))"
_OUT = f"""CASE WHEN code THEN line
 WHEN island IS NOT NULL THEN t || CASE WHEN place = 1 AND n > 1 AND NOT ruled THEN chr(10) || '|' || rtrim(repeat(' --- |', CAST(greatest(1, {_PIPES('t')}) AS BIGINT))) ELSE '' END || CASE WHEN place = n THEN chr(10) ELSE '' END
 WHEN regexp_matches(t, '^#{{1,6}}\\s+.+$') THEN regexp_extract(t, '^(#{{1,6}})', 1) || ' ' || regexp_extract(t, '^#{{1,6}}\\s+(.+)$', 1)
 WHEN length(t) <= 100 AND regexp_matches(t, '^[A-Z][A-Z0-9\\s_-]+$') THEN '## ' || array_to_string(list_transform(string_split(lower(t), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')
 WHEN regexp_matches(t, '^\\d+(?:\\.\\d+)*\\s+[A-Z].+$') THEN repeat('#', CAST(least(6, 2 + length({_NUMBER}) - length(replace({_NUMBER}, '.', ''))) AS BIGINT)) || ' ' || t
 WHEN regexp_matches(t, '^[-*+]\\s+.+') OR regexp_matches(t, '^\\d+\\.\\s+.+') THEN line
 WHEN regexp_matches(t, '^[{M.BULLETS}]\\s*.+$') THEN {_INDENT} || '- ' || regexp_extract(t, '^[{M.BULLETS}]\\s*(.+)$', 1)
 WHEN regexp_matches(t, {_MARKED}) THEN {_INDENT} || CASE WHEN regexp_matches(regexp_extract(t, {_MARKED}, 1), '^[0-9]') THEN regexp_extract(t, {_MARKED}, 1) || '. ' ELSE '- ' END || regexp_extract(t, {_MARKED}, 2)
 WHEN regexp_matches(t, '(?i)<!--\\s*IMAGE[^>]*IMG_?(\\d+)[^>]*-->') THEN '![image](embedded:img_' || regexp_extract(t, '(?i)<!--\\s*IMAGE[^>]*IMG_?(\\d+)[^>]*-->', 1) || ')'
 WHEN regexp_matches(t, '(?i)\\[image:([^\\]]+)\\]') THEN '![' || regexp_extract(t, '(?i)\\[image:([^\\]]+)\\]', 1) || '](embedded:img_000)'
 WHEN contains(t, 'embedded:img_') THEN t WHEN regexp_matches(t, '(?i)\\[img_?(\\d+)\\]') THEN '![image](embedded:img_' || regexp_extract(t, '(?i)\\[img_?(\\d+)\\]', 1) || ')' ELSE line END"""


_ISLANDS = f"""src AS (SELECT doc_id, {_PLAIN} AS text FROM decorated), l AS (SELECT *, trim(line, {_B}) AS t FROM ({_LINES('src')})),
 f AS (SELECT *, starts_with(t, '```') OR starts_with(t, '~~~') AS fence FROM l), c AS (SELECT *, fence OR sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS code FROM f),
 m AS (SELECT *, NOT code AND {_PIPES('t')} >= 2 AND NOT starts_with(t, '>') AS member FROM c), s AS (SELECT *, CASE WHEN member THEN i - row_number() OVER (PARTITION BY doc_id, member ORDER BY i) END AS island FROM m),
 p AS (SELECT *, bool_or(regexp_matches(t, '^\\|?\\s*[-:]+\\s*\\|')) OVER (PARTITION BY doc_id, island) AS ruled, count(*) OVER (PARTITION BY doc_id, island) AS n, row_number() OVER (PARTITION BY doc_id, island ORDER BY i) AS place FROM s)"""


@query(
    "m01_markdown",
    f"""WITH {DUCK_DECORATED}, {_ISLANDS},
    o AS (SELECT doc_id, string_agg({_OUT}, chr(10) ORDER BY i) AS text FROM p GROUP BY doc_id) SELECT doc_id, {duckdb('text', RULES['markdown_spacing'])} AS text FROM o""",
)
def plain_to_markdown(spark, sf_dir):
    """M01 to M06 in one pass: fences, tables with their separators, headings, lists and images of plain lines."""
    src = decorated(spark, sf_dir).select("doc_id", F.expr(_PLAIN.replace("chr(10)", "'\\n'")).alias("text"))
    return M.to_markdown(src)


#: Irregular tables in place of regular ones, by doc_id.
_TABLES = """replace(text, '|---|---|', CASE doc_id % 5 WHEN 0 THEN '|---|---|' WHEN 1 THEN '| x | y | z |' WHEN 2 THEN '| only | two |' WHEN 3 THEN '|---|---|' || chr(10) || '| ' || repeat('long ', 50) || '| b |' || chr(10) || '| c | d |' || chr(10) || '| e | f |'
 || chr(10) || '| e | f |' || chr(10) || '| e | f |' ELSE '|:--|--:|' || chr(10) || chr(10) END) || chr(10) || chr(10) || chr(10) || chr(10) || '| single |'"""
_H, _I = "'^(#{1,6})\\s+(.*)$'", "'^(\\s*)([-*+]|\\d+\\.)\\s+(.*)$'"
_CHAIN = f"""{DUCK_DECORATED}, src AS (SELECT doc_id, {_TABLES} AS text FROM decorated), d1 AS (SELECT doc_id, text AS before, {L.DEMOTE_ANNOTATIONS.duckdb('text')} AS text FROM src), d2 AS (SELECT doc_id, before, text AS demoted, {L.DROP_EMPTY_HEADINGS.duckdb('text')} AS text FROM d1),
 l3 AS (SELECT *, CASE WHEN regexp_matches(line, {_H}) THEN length(regexp_extract(line, {_H}, 1)) END AS own FROM ({_LINES('d2')})), h3 AS (SELECT doc_id, i, own, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l3 WHERE own IS NOT NULL),
 r3 AS (SELECT doc_id, i, k, CASE WHEN own > 2 THEN 1 ELSE own END AS level FROM h3 WHERE k = 1 UNION ALL SELECT h.doc_id, h.i, h.k, least(h.own, r.level + 1) FROM r3 r JOIN h3 h ON h.doc_id = r.doc_id AND h.k = r.k + 1),
 n3 AS (SELECT l3.doc_id, l3.i, own, level, CASE WHEN level <> own THEN repeat('#', level) || ' ' || regexp_extract(line, {_H}, 2) ELSE line END AS line FROM l3 LEFT JOIN r3 USING (doc_id, i)),
 l4 AS (SELECT doc_id, i, line, CASE WHEN regexp_matches(line, {_I}) THEN length(regexp_extract(line, {_I}, 1)) END AS own, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n3 WHERE trim(line, {_B}) <> '' OR regexp_matches(line, {_I})),
 r4 AS (SELECT doc_id, i, k, own AS now FROM l4 WHERE k = 1 UNION ALL SELECT l.doc_id, l.i, l.k, CASE WHEN l.own > r.now + 4 THEN r.now + 2 ELSE l.own END FROM r4 r JOIN l4 l ON l.doc_id = r.doc_id AND l.k = r.k + 1),
 n4 AS (SELECT n3.doc_id, n3.i, CASE WHEN r4.now <> l4.own THEN repeat(' ', r4.now) || regexp_extract(n3.line, {_I}, 2) || ' ' || regexp_extract(n3.line, {_I}, 3) ELSE n3.line END AS line, coalesce(r4.now <> l4.own, false) AS moved FROM n3 LEFT JOIN l4 USING (doc_id, i) LEFT JOIN r4 USING (doc_id, i)),
 m5 AS (SELECT *, regexp_matches(line, '{M.TABLE_ROW}') AS member, regexp_matches(line, '{M.TABLE_RULE}') AS rule FROM n4), s5 AS (SELECT *, CASE WHEN member THEN i - row_number() OVER (PARTITION BY doc_id, member ORDER BY i) END AS island FROM m5),
 t5 AS (SELECT doc_id, island, min(i) AS first, count(*) AS n, count(*) FILTER (WHERE rule) AS rules, min(CASE WHEN NOT rule THEN CASE WHEN {_PIPES('line')} > 1 THEN {_PIPES('line')} - 1 ELSE {_PIPES('line')} END END) AS least, max(CASE WHEN NOT rule THEN CASE WHEN {_PIPES('line')} > 1 THEN {_PIPES('line')} - 1 ELSE {_PIPES('line')} END END) AS most,
   flatten(list(CASE WHEN NOT rule THEN list_transform(list_filter(string_split(line, '|'), lambda c: c <> ''), lambda c: length(trim(c, {_B}))) ELSE [] END)) AS lengths,
   string_agg(trim(replace(regexp_replace(regexp_replace(trim(line, {_B}), '^\\|', ''), '\\|$', ''), '|', chr(9)), {_B}), chr(10) ORDER BY i) FILTER (WHERE NOT rule AND trim(replace(regexp_replace(regexp_replace(trim(line, {_B}), '^\\|', ''), '\\|$', ''), '|', chr(9)), {_B}) <> '') AS bare FROM s5 WHERE island IS NOT NULL GROUP BY doc_id, island),
 v5 AS (SELECT *, CASE WHEN n < 2 THEN 'Table has fewer than 2 rows' WHEN least IS NULL THEN 'No data rows in table' WHEN most - least > 0 THEN 'Column count varies from ' || least || ' to ' || most || ' (variance: ' || (most - least) || ', max allowed: 0)'
   WHEN rules = 0 AND n > 2 THEN 'Complex table structure (missing separator)' WHEN list_max(lengths) > 5 * list_sum(lengths) / len(lengths) AND list_max(lengths) > 100 THEN 'Complex table structure (possible merged cells)' END AS reason FROM t5),
 n5 AS (SELECT s5.doc_id, string_agg(CASE WHEN reason IS NULL THEN line ELSE '<!-- table: ' || reason || ' -->' || chr(10) || '<table>' || chr(10) || coalesce(bare || chr(10), '') || '</table>' END, chr(10) ORDER BY i) AS text FROM s5 LEFT JOIN v5 USING (doc_id, island) WHERE reason IS NULL OR i = first GROUP BY s5.doc_id),
 b6 AS (SELECT doc_id, regexp_replace(text, '(?m)[ \\t\\r]+$', '', 'g') AS text FROM n5), n6 AS (SELECT doc_id, text AS before, regexp_replace(regexp_replace(regexp_replace(text, '\\A\\n{{3,}}', chr(10) || chr(10)), '\\n{{3,}}\\z', chr(10) || chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS text FROM b6)"""
_LEN = lambda x: f"len(string_split({x}, chr(10)))"
_DIFF = "len(list_filter(list_zip(string_split(before, chr(10)), string_split(demoted, chr(10))), lambda x: x[1] <> x[2]))"


def irregular(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", F.expr(_TABLES.replace("chr(10)", "'\\n'")).alias("text"))


@query(
    "n07_normalised",
    f"""WITH RECURSIVE {_CHAIN}, c AS (SELECT doc_id, {_LEN('before')} AS total_lines, {_LEN('demoted')} - {_LEN('text')} AS headings_removed, {_DIFF} AS headings_demoted FROM d2),
    a AS (SELECT doc_id, count(*) FILTER (WHERE level <> own) AS headings_adjusted FROM n3 GROUP BY doc_id), i AS (SELECT doc_id, count(*) FILTER (WHERE moved) AS list_items_normalized FROM n4 GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS tables_found, count(reason) AS tables_converted FROM v5 GROUP BY doc_id)
    SELECT n6.doc_id, n6.text, total_lines, len(list_filter(string_split(n6.text, chr(10)), lambda x: regexp_matches(x, {_H}))) AS headings_found, headings_adjusted, headings_removed, headings_demoted, list_items_normalized, {_LEN('n6.before')} - {_LEN('n6.text')} AS blank_lines_removed,
    coalesce(tables_found, 0) AS tables_found, coalesce(tables_converted, 0) AS tables_converted, coalesce(tables_found - tables_converted, 0) AS tables_preserved FROM n6 JOIN c USING (doc_id) JOIN a USING (doc_id) JOIN i USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def normalised(spark, sf_dir):
    """The repaired text and its ten counters."""
    return M.normalise(irregular(spark, sf_dir)).drop("actions")


@query(
    "n07_actions",
    f"""WITH RECURSIVE {_CHAIN} SELECT doc_id, 5 AS stage, first + 1 AS line, CASE WHEN contains(lower(reason), 'complex') THEN 'ComplexTableConverted' ELSE 'MalformedTableConverted' END AS kind, 'Table with ' || n || ' rows' AS before, reason AS after FROM v5 WHERE reason IS NOT NULL
    UNION ALL SELECT doc_id, 6, 0, 'ExcessiveBlankLinesRemoved', CAST({_LEN('before')} - {_LEN('text')} AS VARCHAR), '' FROM n6 WHERE {_LEN('before')} > {_LEN('text')}
    UNION ALL SELECT l3.doc_id, 3, l3.i + 1, CASE WHEN level = 1 THEN 'FirstHeadingPromoted' ELSE 'HeadingLevelAdjusted' END, l3.line, n3.line FROM l3 JOIN n3 USING (doc_id, i) WHERE n3.level <> l3.own
    UNION ALL SELECT n4.doc_id, 4, n4.i + 1, 'ListIndentNormalized', n3.line, n4.line FROM n4 JOIN n3 USING (doc_id, i) WHERE moved
    UNION ALL SELECT doc_id, 1, i, 'AnnotationHeadingDemoted', x[1], x[2] FROM (SELECT doc_id, unnest(list_zip(string_split(before, chr(10)), string_split(demoted, chr(10)))) AS x, generate_subscripts(string_split(before, chr(10)), 1) AS i FROM d2) WHERE x[1] <> x[2]
    UNION ALL SELECT doc_id, 2, i, 'EmptyHeadingRemoved', x, '' FROM (SELECT doc_id, unnest(string_split(demoted, chr(10))) AS x, generate_subscripts(string_split(demoted, chr(10)), 1) AS i FROM d2) WHERE regexp_matches(trim(x, {_B}), '^#{{1,6}}\\s*$')""",
)
def normaliser_actions(spark, sf_dir):
    """The log, a row for each action."""
    return M.normalise(irregular(spark, sf_dir)).select("doc_id", F.explode("actions").alias("a")).select("doc_id", "a.*")


# R17 whole: conversion, normalisation, structures, preset, whitespace, sections, scores

_LISTS = r"(?:^[ \t]*(?:[-*+]|\d+\.)[ \t]+[^\n]*(?:\n|\z)){3,}"
_TABLE = r"^\|[^\n]+\|\n\|[-:|\t ]+\|\n(?:\|[^\n]+\|(?:\n|\z))+"
_STRUCTURES = ("```(\\w+)?[ \\t]*\\n([\\s\\S]*?)```", _TABLE, _LISTS)
_STANDARD = (RULES["clean_noise"], RULES["normalize_whitespace"], RULES["normalize_whitespace"])
_AFTER = "text"
for _rule in _STANDARD:
    _AFTER = duckdb(_AFTER, _rule)


@query(
    "r17_refined_documents",
    f"""WITH RECURSIVE {DUCK_DECORATED}, {_ISLANDS}, o AS (SELECT doc_id, string_agg({_OUT}, chr(10) ORDER BY i) AS text FROM p GROUP BY doc_id), converted AS (SELECT doc_id, {duckdb('text', RULES['markdown_spacing'])} AS text FROM o),
    {_CHAIN.split("AS text FROM decorated), ", 1)[1].replace("FROM src)", "FROM converted)")},
    y17 AS (SELECT n6.doc_id, src.text AS raw, n6.text AS normal, n6.text AS text FROM n6 JOIN src USING (doc_id)), z17 AS (SELECT doc_id, raw, normal, {_AFTER} AS text FROM y17),
    q17 AS (SELECT doc_id, text, length(raw) AS before, length(text) AS after, len(regexp_extract_all(normal, '{_STRUCTURES[0]}')) AS code_blocks, len(regexp_extract_all(normal, '(?m){_TABLE}')) AS tables, len(regexp_extract_all(normal, '(?m){_LISTS}')) AS lists, len(regexp_extract_all(text, '(?m)^#{{1,6}}[ \\t]+[^\\n]+')) AS sections FROM z17),
    r17 AS (SELECT *, CASE WHEN before = 0 THEN 0e0 ELSE 1 - after / before::DOUBLE END AS cut, CASE WHEN code_blocks + tables + lists > 0 AND sections > 0 THEN 0.9e0 WHEN code_blocks + tables + lists > 0 OR sections > 0 THEN 0.7e0 ELSE 0.5e0 END AS structure FROM q17),
    s17 AS (SELECT *, CASE WHEN before = 0 THEN 1e0 WHEN cut BETWEEN 0.05e0 AND 0.2e0 THEN 0.9e0 WHEN cut >= 0 AND cut < 0.05e0 THEN 0.8e0 WHEN cut > 0.2e0 AND cut <= 0.35e0 THEN 0.7e0 ELSE 0.5e0 END AS cleanup, CASE WHEN before = 0 THEN 1e0 ELSE least(1e0, after / before::DOUBLE) END AS retention FROM r17)
    SELECT doc_id, md5(text) AS digest, after AS n_chars, code_blocks, tables, lists, sections, structure, cleanup, round(retention, 9) AS retention, 0.75e0 AS confidence, round((structure + cleanup + retention + 0.75e0) / 4, 6) AS overall FROM s17""",
)
def refined_documents(spark, sf_dir):
    """R17 in full: plain lines to markdown (M01-M06), normalisation (N01-N07), structures, the standard preset, whitespace, sections, scores."""
    src = decorated(spark, sf_dir).select("doc_id", F.expr(_PLAIN.replace("chr(10)", "'\\n'")).alias("text"))
    return M.refined(src, _STRUCTURES, _STANDARD)


#: Tables by part brand: ragged rows, pipes, blanks and an alignment for each of some columns.
_CELLS = """CASE WHEN n_nationkey % 4 = 0 THEN array(CAST(n_nationkey AS STRING), concat(n_name, ' | x'), 'a', 'b') WHEN n_nationkey % 4 = 1 THEN array(n_name) WHEN n_nationkey % 4 = 2 THEN array(concat(' ', n_name, chr(10), 'y'), NULL) ELSE array('k', 'v', 'w') END"""
_DUCK_CELLS = "CASE WHEN n_nationkey % 4 = 0 THEN [CAST(n_nationkey AS VARCHAR), n_name || ' | x', 'a', 'b'] WHEN n_nationkey % 4 = 1 THEN [n_name] WHEN n_nationkey % 4 = 2 THEN [' ' || n_name || chr(10) || 'y', NULL] ELSE ['k', 'v', 'w'] END"
_CELL = lambda x: f"trim(replace(replace(replace(coalesce({x}, ''), '|', '\\|'), chr(10), ' '), chr(13), ''))"
_ROW = lambda x: f"'| ' || array_to_string(list_transform(range(1, width + 1), lambda i: {_CELL(x + '[i]')}), ' | ') || ' |'"
_RULE = "CASE i " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in ((1, ":---"), (2, "---:"), (3, ":---:"))) + " ELSE '---' END"


@query(
    "m07_tables",
    f"""WITH r AS (SELECT n_regionkey AS table_id, n_nationkey, {_DUCK_CELLS} AS cells FROM nation), t AS (SELECT table_id, list(cells ORDER BY n_nationkey) AS cells, max(len(cells)) AS width FROM r GROUP BY table_id), h AS (SELECT *, table_id % 2 = 0 AS has_header FROM t),
    n AS (SELECT *, CASE WHEN has_header THEN cells[1] ELSE [] END AS head, CASE WHEN has_header THEN cells[2:] ELSE cells END AS rest FROM h)
    SELECT table_id, '| ' || array_to_string(list_transform(range(1, width + 1), lambda i: CASE WHEN len(head) >= i THEN {_CELL('head[i]')} ELSE 'Col' || i END), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(range(1, width + 1), lambda i: {_RULE}), ' | ') || ' |' || chr(10)
     || array_to_string(list_transform(rest, lambda x: {_ROW('x')}), chr(10)) || CASE WHEN table_id >= 3 THEN chr(10) || '<!-- Table confidence: 0.' || table_id || '5 - may need verification -->' ELSE '' END AS markdown,
     len(rest) AS n_rows, width AS n_columns, 'Table ' || table_id || ' (' || len(cells) || '×' || width || ')' || CASE WHEN table_id >= 3 THEN ' [low confidence]' ELSE '' END AS caption FROM n""",
)
def tables(spark, sf_dir):
    """Tables of cells as markdown and as structures with a caption."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("table_id"), "n_nationkey", F.expr(_CELLS).alias("cells"))
    t = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "cells")))["cells"].alias("cells")).withColumn("has_header", F.col("table_id") % 2 == 0)
    doubtful, width = F.col("table_id") >= 3, F.array_max(F.transform("cells", F.size))
    text = M.table_markdown(F.col("cells"), F.col("has_header"), F.array(*map(F.lit, ("Left", "Right", "Center"))), (F.col("table_id") * 10 + 5) / 100.0, doubtful)
    size = F.concat(F.lit("Table "), F.col("table_id").cast("string"), F.lit(" ("), F.size("cells").cast("string"), F.lit("×"), width.cast("string"), F.lit(")"))
    return t.select("table_id", text.alias("markdown"), (F.size("cells") - F.col("has_header").cast("int")).alias("n_rows"), width.alias("n_columns"), F.concat(size, F.when(doubtful, " [low confidence]").otherwise("")).alias("caption"))


_KINDS = "Heading ListItem CodeBlock Quote Header Footer Caption TocEntry Note Paragraph".split()
_KIND = "CASE (i + doc_id) % 10 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(_KINDS)) + " END"
#: A page for seven lines; y falls down the page; every third line has no box, so its order stands in.
_PAGE, _Y = "CAST(floor(i / 7) AS INT)", "CASE WHEN i % 3 = 0 THEN i * 100e0 ELSE 700e0 - 100 * (i % 7) END"
_BLOCK_SQL = """CASE kind WHEN 'Heading' THEN repeat('#', CAST(1 + i % 6 AS BIGINT)) || ' ' || line WHEN 'ListItem' THEN repeat('  ', CAST(i % 6 AS BIGINT)) || CASE WHEN i % 2 = 0 THEN '1. ' ELSE '- ' END || line WHEN 'CodeBlock' THEN '```' || chr(10) || line || chr(10) || '```' WHEN 'Quote' THEN '> ' || line
 WHEN 'Header' THEN '<!-- Header: ' || line || ' -->' WHEN 'Footer' THEN '<!-- Footer: ' || line || ' -->' WHEN 'Caption' THEN '*' || line || '*' WHEN 'TocEntry' THEN '- ' || line WHEN 'Note' THEN '> **Note:** ' || line ELSE line END"""
_MIME = "CASE doc_id % 4 WHEN 0 THEN 'image/PNG' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/svg+xml' ELSE 'image/tiff' END"


@query(
    "m09_interleaved",
    f"""WITH l AS ({_LINES("documents WHERE text IS NOT NULL")}), b AS (SELECT doc_id, {_PAGE} AS page, {_Y} AS y, i AS ord, line, {_KIND} AS kind, i FROM l), k AS (SELECT doc_id, page, y, ord, {_BLOCK_SQL} AS markdown FROM b WHERE trim(line, {_B}) <> ''),
    m AS (SELECT doc_id, 0 AS page, 450e0 AS y, -1 AS ord, '![' || CASE WHEN doc_id % 3 = 0 THEN 'A caption' WHEN doc_id % 3 = 1 THEN 'Image on page 0 (640x480)' ELSE 'Image img_' || doc_id END || '](images/img_' || doc_id || '.' || CASE doc_id % 4 WHEN 1 THEN 'jpg' WHEN 2 THEN 'svg' ELSE 'png' END || ')' AS markdown FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, string_agg(markdown, chr(10) || chr(10) ORDER BY page, y DESC, ord) AS text FROM (SELECT * FROM k UNION ALL SELECT * FROM m) GROUP BY doc_id""",
)
def interleaved(spark, sf_dir):
    """Blocks of pages as markdown by kind, images between them by place."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    blocks = M.numbered(docs).withColumns({"kind": F.expr(_KIND), "page": F.expr(_PAGE), "y": F.expr(_Y.replace("e0", "D"))})
    level = F.when(F.col("kind").isin("Heading", "ListItem"), F.col("i") % 6 + 1)
    written = blocks.select("doc_id", "page", "y", F.col("i").alias("ord"), M.block_markdown(F.col("kind"), F.col("line"), level, F.col("i") % 2 == 0).alias("markdown"))
    ident, sized = F.concat(F.lit("img_"), F.col("doc_id").cast("string")), F.col("doc_id") % 3 == 1
    picture = M.image_markdown(ident, F.expr(_MIME), F.when(F.col("doc_id") % 3 == 0, "A caption"), F.lit(0), F.when(sized, 640).otherwise(0), F.when(sized, 480).otherwise(0))
    images = docs.select("doc_id", F.lit(0).alias("page"), F.lit(450.0).alias("y"), F.lit(-1).alias("ord"), picture.alias("markdown"))
    return M.interleaved(written.unionByName(images))
