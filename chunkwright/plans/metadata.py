"""Metadata queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwright.functions.rewrite import quoted
from chunkwright.operators import metadata as M
from chunkwright.plans.corpora import DUCK_DECORATED, decorated, table
from chunkwright.plans.registry import query

#: A line of each kind that the field rules read, put before documents by doc_id.
_LEAD = """CASE doc_id % 8 WHEN 0 THEN 'Acme Widget User Guide' || chr(10) || 'Copyright 2021 Acme Corporation' WHEN 1 THEN 'Product: Widget 5' || chr(10) || 'Version 2.10.1' WHEN 2 THEN 'Company: Some Firm, x' || chr(10) || 'Firmware 3.4'
 WHEN 3 THEN 'Released: 12/05/2020' || chr(10) || 'import numpy' WHEN 4 THEN 'Date: May 5, 2021' || chr(10) || 'from os import path' || chr(10) || 'using React; Docker' WHEN 5 THEN 'a specification 2020-01-02' || chr(10) || 'require("fs-extra") Python SQL'
 WHEN 6 THEN 'tutorial of code api system method function contract' || chr(10) || 'use Some.Space; © 2020 Bold Works, ltd import { a, b } from "es-lib"' ELSE 'plain' END || chr(10) || text"""
_DUCK = f"lead AS (SELECT doc_id, {_LEAD} AS text FROM documents WHERE text IS NOT NULL)"


def led(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.expr(_LEAD).alias("text"))


_BLANKS = "' ' || chr(9) || chr(13) || chr(10)"
_FIRST = lambda ps: "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(text, {quoted(p)}, 1), {_BLANKS}), '')" for p in ps) + ")"


@query("d01_manual_fields", f"WITH {_DUCK} SELECT doc_id, {_FIRST(M.PRODUCT)} AS product, {_FIRST(M.COMPANY)} AS company, {_FIRST(M.VERSION)} AS version, {_FIRST(M.RELEASED)} AS released FROM lead")
def manual_fields(spark, sf_dir):
    t = F.col("text")
    return led(spark, sf_dir).select("doc_id", *[M.first_match(t, p).alias(n) for n, p in (("product", M.PRODUCT), ("company", M.COMPANY), ("version", M.VERSION), ("released", M.RELEASED))])


_LIBS = "flatten([" + ", ".join(f"regexp_extract_all(text, {quoted(p)}, 1)" for p in M.LIBRARIES) + "])"
_MENTION = lambda terms: "array_to_string(list_slice(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), {quoted(t.lower())}) THEN {quoted(t)} END" for t in terms) + "], lambda x: x IS NOT NULL), 1, 10), ',')"


@query(
    "d02_technical_fields",
    f"WITH {_DUCK} SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({_LIBS}, lambda x: NOT starts_with(x, '.') AND NOT starts_with(x, '/') AND length(x) > 2))), ',') AS libraries, {_MENTION(M.FRAMEWORKS)} AS frameworks, {_MENTION(M.TECHNOLOGIES)} AS technologies FROM lead",
)
def technical_fields(spark, sf_dir):
    t = F.col("text")
    return led(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(M.libraries(t)), ",").alias("libraries"), F.array_join(M.mentioned(t, M.FRAMEWORKS), ",").alias("frameworks"), F.array_join(M.mentioned(t, M.TECHNOLOGIES), ",").alias("technologies"))


_HEADS = f"list_filter(list_transform(regexp_extract_all(text, '(?m)^#{{1,3}}\\s+(.+)$', 1), lambda x: trim(x, {_BLANKS})), lambda x: length(x) > 3 AND length(x) < 60)"
_NUMBERED = f"list_transform(regexp_extract_all(text, '(?m)^\\d+[\\.\\)]\\s+([A-Z][^\\r\\n]{{3,60}})', 1), lambda x: trim(x, {_BLANKS}))"


@query(
    "d04_topics",
    f"WITH {DUCK_DECORATED}, e AS (SELECT doc_id, list_concat({_HEADS}, {_NUMBERED}) AS every FROM decorated), l AS (SELECT doc_id, every, list_transform(every, lambda x: lower(x)) AS low FROM e) "
    "SELECT doc_id, array_to_string(list_slice(list_filter(every, lambda x, i: list_position(low, lower(x)) = i), 1, 5), '|') AS topics FROM l",
)
def topics(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", F.array_join(M.topics(F.col("text")), "|").alias("topics"))


_STOPS = "(" + ", ".join(map(quoted, M.KEYWORD_STOPS)) + ")"


@query(
    "d05_keywords",
    f"""WITH w AS (SELECT doc_id, lower(unnest(string_split_regex(text, '\\W+'))) AS w, generate_subscripts(string_split_regex(text, '\\W+'), 1) AS i FROM documents),
    c AS (SELECT doc_id, w, count(*) AS n, min(i) AS pos FROM w WHERE length(w) > 3 AND length(w) < 30 AND w NOT IN {_STOPS} AND NOT regexp_matches(w, '^\\d+$') GROUP BY 1, 2)
    SELECT doc_id, w AS keyword, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos, w) AS rank FROM c) WHERE rank <= 10""",
)
def keywords(spark, sf_dir):
    return M.keywords(table(spark, sf_dir, "documents"))


_TYPE = f"CASE WHEN trim(text, {_BLANKS}) = '' THEN 'unknown' " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), {quoted(t)})" for t in terms) + f" THEN '{k}'" for k, terms in M.TYPES.items()) + " ELSE 'document' END"


@query("d07_document_type", f"WITH {_DUCK} SELECT doc_id, {_TYPE} AS kind FROM lead")
def document_type(spark, sf_dir):
    return led(spark, sf_dir).select("doc_id", M.document_type(F.col("text")).alias("kind"))


_W = "list_filter(string_split(text, ' '), lambda w: w <> '')"
_HITS = lambda terms: f"len(regexp_extract_all(lower(text), '\\b(?:{'|'.join(terms.split())})\\b'))"


_FILE = "CASE doc_id % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'docx' WHEN 2 THEN 'pdf' ELSE 'txt' END"
#: Words of three categories put before some texts, so that scores pass the least one.
_FIELD = "CASE doc_id % 8 WHEN 5 THEN 'The abstract and methodology of this research study. ' WHEN 3 THEN 'A legal contract: this agreement has a clause on liability. ' WHEN 4 THEN 'the class and method of the code: an api function ' WHEN 1 THEN 'business strategy of customer and product ' ELSE '' END"
_FACTOR = lambda c: f"CASE WHEN extension IN ({', '.join(map(quoted, M.BOOSTS[c][0]))}) THEN {M.BOOSTS[c][1]}e0 ELSE 1e0 END" if c in M.BOOSTS else "1e0"
_SUBTYPE = "CASE " + " ".join(
    "WHEN category = " + quoted(kind) + " AND (" + " OR ".join(" AND ".join(f"contains(text, {quoted(w)})" for w in lot) or "true" for lot in lots) + f") THEN {quoted(name)}" for kind, rules in M.SUBTYPES.items() for name, lots in rules
) + " END"


@query(
    "d12_category",
    f"WITH {_DUCK}, f AS (SELECT doc_id, {_FIELD} || text AS text, {_FILE} AS extension FROM lead), h AS (SELECT doc_id, text, extension, len({_W}) AS n, {', '.join(f'{_HITS(t)} AS {c.lower()}' for c, t in M.CATEGORIES.items())} FROM f), s AS ("
    + " UNION ALL ".join(f"SELECT doc_id, text, '{c}' AS category, {i} AS k, CASE WHEN n > 0 THEN least(1e0, {c.lower()} / n * 100) ELSE 0e0 END * {_FACTOR(c)} AS score FROM h" for i, c in enumerate(M.CATEGORIES))
    + "), r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, k)) "
    f"SELECT doc_id, CASE WHEN score < 0.3 THEN 'General' ELSE category END AS category, CASE WHEN score >= 0.3 THEN {_SUBTYPE} END AS subtype, round(CASE WHEN score < 0.3 THEN 0.5e0 ELSE least(1e0, (score - next) * 2 + score) END, 9) AS confidence FROM r WHERE rank = 1",
)
def category(spark, sf_dir):
    """The best of seven scores per document, boosted by file type, picked within the row; and the category's subtype."""
    docs = led(spark, sf_dir).select("doc_id", F.concat(F.expr(_FIELD), "text").alias("text"), F.expr(_FILE).alias("extension"))
    scores = M.boosted(M.category_scores(F.col("text")), F.col("extension"))
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("k"), F.lit(c).alias("category")) for i, (c, s) in enumerate(scores.items())])))
    found = docs.select("doc_id", "text", ranked.alias("r")).select("doc_id", "text", F.col("r")[0].alias("a"), F.col("r")[1].alias("b"))
    sure = F.least(F.lit(1.0), (F.col("a.score") - F.col("b.score")) * 2 + F.col("a.score"))
    weak = F.col("a.score") < 0.3
    return found.select(
        "doc_id", F.when(weak, "General").otherwise(F.col("a.category")).alias("category"), F.when(~weak, M.subtype(F.col("a.category"), F.col("text"))).alias("subtype"), F.round(F.when(weak, 0.5).otherwise(sure), 9).alias("confidence")
    )


_S = "string_split_regex(text, '[.!?]+')"
_SENT = f"list_sum(list_transform({_S}, lambda s: len(list_filter(string_split(s, ' '), lambda w: w <> '')))) / len({_S})"


@query(
    "d13_complexity",
    f"SELECT doc_id, round(CASE WHEN len({_W}) = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, list_sum(list_transform({_W}, lambda w: length(w))) / len({_W}) / 10 * 0.3e0 + {_SENT} / 30 * 0.4e0 + (1 - len(list_distinct({_W})) / len({_W})) * 0.3e0)) END, 9) AS complexity, "
    f"len({_W}) AS n_words, len(string_split(text, chr(10))) AS n_lines, contains(text, '```') OR contains(text, 'def ') OR contains(text, 'function ') AS has_code FROM documents WHERE text IS NOT NULL",
)
def complexity(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        "doc_id", F.round(M.complexity(t), 9).alias("complexity"), F.size(M.words(t)).alias("n_words"), F.size(F.split(t, "\n")).alias("n_lines"), (t.contains("```") | t.contains("def ") | t.contains("function ")).alias("has_code")
    )


@query("d10_truncated", "SELECT doc_id, left(text, 2000) AS fast, left(text, 4000) AS smart, left(text, 8000) AS deep FROM documents")
def truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.left("text", F.lit(n)).alias(name) for name, n in (("fast", 2000), ("smart", 4000), ("deep", 8000))])


@query("d16_parser_summary", "SELECT doc_id, substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS summary, len(string_split(text, chr(10) || chr(10))) AS n_sections FROM documents WHERE text IS NOT NULL")
def parser_summary(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.substring(t, 1, 200), F.when(F.length(t) > 200, "...").otherwise("")).alias("summary"), F.size(F.split(t, "\n\n")).alias("n_sections"))
