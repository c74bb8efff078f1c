"""Chunk scoring queries. All neighbour metrics share one window, so one sort by document serves them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chunkwright.functions import scores as S
from chunkwright.functions.rewrite import quoted
from chunkwright.plans.corpora import DUCK_CHUNKS, DUCK_DECORATED, chunks, decorated, table
from chunkwright.plans.registry import query

_IN = lambda words: "(" + ", ".join(map(quoted, words)) + ")"
_T = "trim(content, ' ' || chr(9) || chr(13) || chr(10))"
_W = "list_filter(string_split(content, ' '), lambda w: w <> '')"
_WL = "list_filter(string_split(lower(content), ' '), lambda w: w <> '')"
_PIECES = "list_filter(string_split_regex(content, '[.!?]'), lambda s: s <> '')"
_ANY = lambda x, terms: "(" + " OR ".join(f"contains({x}, {quoted(t)})" for t in terms) + ")"
_SUM = lambda x, terms: "(" + " + ".join(f"CAST(contains({x}, {quoted(t)}) AS INT)" for t in terms) + ")"
_NUM = lambda c: f"CASE WHEN {c} THEN 1e0 ELSE 0e0 END"
_ENDS = lambda x: f"regexp_matches({x}, '[.!?]\\z')"
_UPPER = lambda x: f"regexp_matches({x}, '\\A\\p{{Lu}}')"

D_COMPLETENESS = f"CASE WHEN {_T} = '' THEN 0e0 ELSE 0.5e0 + 0.2e0 * {_NUM(_ENDS(_T))} + 0.1e0 * {_NUM(_UPPER(_T))} + 0.2e0 * {_NUM(f'length({_T}) > 50 AND length({_T}) < 2000')} END"
_REP = f"(1 - len(list_distinct(list_transform({_W}, lambda w: lower(w)))) / len({_W}))"
D_COHERENCE = (
    f"CASE WHEN content = '' THEN 0e0 WHEN len(list_filter(string_split(content, '.'), lambda s: s <> '')) < 2 THEN 0.8e0 "
    f"ELSE least(1e0, 0.5e0 + least(0.3e0, 0.1e0 * {_SUM('lower(content)', S.TRANSITIONS)}) + 0.2e0 * {_NUM(f'{_REP} > 0.1 AND {_REP} < 0.5')}) END"
)
D_DENSITY = f"CASE WHEN len({_W}) > 0 THEN len(list_filter({_W}, lambda w: length(w) > 3 AND lower(w) NOT IN {_IN(S.STOP_WORDS)})) / len({_W}) ELSE 0e0 END"
_N = f"greatest(len({_W}), 1)"
D_DEPENDENCY = f"""CASE WHEN {_T} = '' THEN 0e0 ELSE least(1e0,
 0.3e0 * least(1e0, 10 * len(list_filter({_W}, lambda w: regexp_matches(lower(w), '^(?:{'|'.join(S.PRONOUNS)})'))) / {_N})
 + 0.25e0 * least(1e0, {_SUM('lower(content)', S.REFERENCES)} / 3e0)
 + 0.25e0 * least(1e0, 0.3e0 * {_NUM(f"regexp_matches({_T}, '^[a-z가-힣]')")} + 0.4e0 * {_NUM(f"regexp_matches(lower(string_split({_T}, ' ')[1]), '^(and|or|but|however|therefore|thus|hence|also|또한|그리고|하지만|그러나|따라서|그래서)')")}
   + 0.3e0 * {_NUM(f"NOT regexp_matches({_T}, '[.!?。」』]$')")})
 + 0.2e0 * (1 - least(1e0, 5 * len(list_filter({_W}, lambda w: length(w) > 1 AND {_UPPER('w')} AND w NOT IN {_IN(S.SENTENCE_STARTS)})) / {_N}))) END"""
D_RELEVANCE = f"""CASE WHEN {_T} = '' THEN 0e0 ELSE least(1e0, 0.5e0 + 0.1e0 * {_NUM('length(content) > 200')} + 0.1e0 * {_NUM('length(content) > 500')}
 + CASE WHEN len({_PIECES}) > 0 THEN 0.3e0 * len(list_filter({_PIECES}, lambda s: trim(s, ' ' || chr(9) || chr(13) || chr(10)) <> '')) / len({_PIECES}) ELSE 0e0 END) END"""
D_SENTENCES = f"CASE WHEN {_T} = '' OR len({_PIECES}) = 0 THEN 0e0 ELSE greatest(0.7e0, len(list_filter({_PIECES}, lambda s: length(trim(s, ' ' || chr(9) || chr(13) || chr(10))) > 10)) / len({_PIECES})) END"
D_PER_THOUSAND = f"CASE WHEN {_T} = '' THEN 0e0 ELSE (len(list_distinct(list_filter({_W}, lambda w: length(w) > 3))) + len({_PIECES})) * 1000e0 / length(content) END"


@query(
    "q01_chunk_scores",
    f"WITH {DUCK_CHUNKS} SELECT doc_id, chunk_index, round({D_COMPLETENESS}, 6) AS completeness, round({D_COHERENCE}, 6) AS coherence, round({D_DENSITY}, 6) AS density, "
    f"round({D_DEPENDENCY}, 6) AS context_dependency, round({D_RELEVANCE}, 6) AS relevance, round({D_SENTENCES}, 6) AS sentence_completeness, round({D_PER_THOUSAND}, 6) AS per_thousand FROM chunks",
)
def chunk_scores(spark, sf_dir):
    """Q01, Q02, Q07, Q17, Q18, Q19, Q24."""
    frame, c = S.derived(chunks(spark, sf_dir))
    r = lambda x, name: F.round(x, 6).alias(name)
    return frame.select(
        "doc_id", "chunk_index", r(S.completeness(c), "completeness"), r(S.coherence(c), "coherence"), r(S.density(c), "density"), r(S.context_dependency(c), "context_dependency"),
        r(S.relevance(c), "relevance"), r(S.sentence_completeness(c), "sentence_completeness"), r(S.per_thousand(c), "per_thousand"),
    )


def neighbour_columns(frame, own=None):
    """content_next and word sets of a chunk and the one after it."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    own = S.word_set(F.col("content")) if own is None else own
    return frame.withColumn("own", own).withColumn("content_next", F.lead("content").over(w)).withColumn("next", F.lead("own").over(w))


_PAIRS = f"""pairs AS (SELECT doc_id, chunk_index, content, lead(content) OVER w AS content_next, list_distinct({_WL}) AS own, lead(list_distinct({_WL})) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))"""
_UNION = "len(list_distinct(list_concat(own, next)))"
_JACCARD = f"(CASE WHEN {_UNION} = 0 THEN 1e0 ELSE len(list_intersect(own, next)) / {_UNION} END)"
_TN = _T.replace("content", "content_next")
_BOUNDARY = f"(0.5e0 + 0.25e0 * {_NUM(_ENDS(_T))} + 0.25e0 * {_NUM(_UPPER(_TN))})"
_CONTINUITY = f"least(1e0, {_JACCARD} + 0.2e0 * {_NUM(_ANY('content_next', S.CONNECTORS))})"


@query(
    "q04_neighbour_scores",
    f"WITH {DUCK_CHUNKS}, {_PAIRS} SELECT doc_id, chunk_index, round({_BOUNDARY}, 6) AS boundary, round({_JACCARD}, 6) AS overlap, round({_CONTINUITY}, 6) AS continuity FROM pairs WHERE content_next IS NOT NULL",
)
def neighbour_scores(spark, sf_dir):
    """Q04, Q06, Q10, Q12 of each pair of neighbours."""
    pairs = neighbour_columns(chunks(spark, sf_dir)).where("content_next IS NOT NULL")
    overlap = S.jaccard(F.col("own"), F.col("next"))
    boundary = 0.5 + 0.25 * S.number(S.ends_sentence(S.trimmed(F.col("content")))) + 0.25 * S.number(S.starts_upper(S.trimmed(F.col("content_next"))))
    flow = F.least(F.lit(1.0), overlap + 0.2 * S.number(S.contains_any(F.col("content_next"), S.CONNECTORS)))
    return pairs.select("doc_id", "chunk_index", F.round(boundary, 6).alias("boundary"), F.round(overlap, 6).alias("overlap"), F.round(flow, 6).alias("continuity"))


_REPORT_SQL = f"""measured AS (SELECT doc_id, count(*) AS n,
  avg({D_COMPLETENESS}) AS completeness, avg({D_COHERENCE}) AS coherence,
  CASE WHEN count(*) < 2 THEN 1e0 ELSE greatest(0e0, 1 - var_pop(length(content)) / 100000) END AS consistency,
  coalesce(avg(CASE WHEN content_next IS NOT NULL THEN {_BOUNDARY} END), 1e0) AS boundary,
  greatest(0e0, 1 - stddev_pop(length(content)) / avg(length(content))) AS size_distribution,
  coalesce(avg(CASE WHEN content_next IS NOT NULL THEN {_JACCARD} END), 1e0) AS overlap,
  avg({D_DENSITY}) AS density,
  CASE WHEN sum(len({_W})) > 0 THEN least(1e0, 10 * sum({_SUM('lower(content)', S.KEYWORDS)}) / sum(len({_W}))) ELSE 0e0 END AS keyword_richness,
  avg({_NUM(f"regexp_matches(content, '[0-9]') OR {_ANY('content', ['percent', 'result', 'data'])}")}) AS factual,
  coalesce(avg(CASE WHEN content_next IS NOT NULL THEN {_JACCARD} END), 0e0) AS redundancy,
  avg({_NUM(_ANY('content', ['#', '- ', '1.', '•']))}) AS structure,
  coalesce(avg(CASE WHEN content_next IS NOT NULL THEN {_CONTINUITY} END), 1e0) AS continuity,
  avg({_NUM(_ANY('content', ['see', 'refer', 'above', 'below']))}) AS reference_integrity,
  any_value(rich) AS metadata_richness FROM pairs JOIN (SELECT doc_id, CASE WHEN coalesce(source, '') <> '' AND n_chars > 0 THEN 1e0 ELSE 0e0 END AS rich FROM documents) USING (doc_id) GROUP BY doc_id)"""
_MEASURES = "completeness coherence consistency boundary size_distribution overlap density keyword_richness factual redundancy structure continuity reference_integrity metadata_richness".split()
_OVERALL = (
    "0.4e0 * (completeness + coherence + consistency + boundary + size_distribution) / 5 + 0.3e0 * (density + keyword_richness + factual + (1 - redundancy)) / 4 "
    "+ 0.3e0 * (structure + continuity + reference_integrity + metadata_richness) / 4"
)


@query("q15_document_quality", f"WITH {DUCK_CHUNKS}, {_PAIRS}, {_REPORT_SQL} SELECT doc_id, n, {', '.join(f'round({m}, 9) AS {m}' for m in _MEASURES)}, round({_OVERALL}, 9) AS overall FROM measured")
def document_quality(spark, sf_dir):
    """Q01-Q15 by document: averages, spread of sizes, neighbours, overall score."""
    return document_measures(chunks(spark, sf_dir), files(spark, sf_dir)).select("doc_id", "n", *[F.round(m, 9).alias(m) for m in _MEASURES], F.round(F.expr(_OVERALL), 9).alias("overall"))


def files(spark, sf_dir):
    """doc_id, rich: whether a document's metadata name its source and a size (Q14)."""
    named = (F.coalesce("source", F.lit("")) != "") & F.coalesce(F.col("n_chars") > 0, F.lit(False))
    return table(spark, sf_dir, "documents").select("doc_id", S.number(named).alias("rich"))


def mean_in_order(values):
    """Mean of an array's doubles without nulls, summed from its first to its last; null of none."""
    known = F.array_compact(values)
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def document_measures(frame, metadata):
    """Q01-Q15 of chunks (doc_id, chunk_index, content); metadata: doc_id, rich."""
    frame, parts = S.derived(frame)
    pairs = neighbour_columns(frame, S.word_set(parts))
    c, nxt = F.col("content"), F.col("content_next")
    neighbours = lambda x: F.when(nxt.isNotNull(), x)
    overlap = S.jaccard(F.col("own"), F.col("next"))
    values = pairs.select(
        "doc_id", "chunk_index", F.length(c).alias("size"), F.size(parts.words).alias("words"), S.completeness(parts).alias("completeness"), S.coherence(parts).alias("coherence"), neighbours(overlap).alias("overlap"),
        neighbours(0.5 + 0.25 * S.number(S.ends_sentence(parts.trimmed)) + 0.25 * S.number(S.starts_upper(S.trimmed(nxt)))).alias("boundary"), S.density(parts).alias("density"), S.count_contained(parts.low, S.KEYWORDS).alias("keywords"),
        S.number(c.rlike("[0-9]") | S.contains_any(c, ["percent", "result", "data"])).alias("factual"), S.number(S.contains_any(c, ["#", "- ", "1.", "•"])).alias("structure"),
        neighbours(F.least(F.lit(1.0), overlap + 0.2 * S.number(S.contains_any(nxt, S.CONNECTORS)))).alias("continuity"), S.number(S.contains_any(c, ["see", "refer", "above", "below"])).alias("reference_integrity"),
    )
    average = lambda name: F.avg(name).alias(name)
    n_words = F.sum("words")
    measured = values.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.when(F.count("*") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.var_pop("size") / 100000)).alias("consistency"), F.coalesce(F.avg("boundary"), F.lit(1.0)).alias("boundary"),
        F.greatest(F.lit(0.0), 1 - F.stddev_pop("size") / F.avg("size")).alias("size_distribution"), average("density"), F.when(n_words > 0, F.least(F.lit(1.0), 10 * F.sum("keywords") / n_words)).otherwise(0.0).alias("keyword_richness"),
        average("factual"), average("structure"), F.coalesce(F.avg("continuity"), F.lit(1.0)).alias("continuity"), average("reference_integrity"),
        F.collect_list(F.struct("chunk_index", "completeness", "coherence", "overlap")).alias("rows"),
    )
    # advice compares these with thresholds that they often meet, so their sums have a stated order, from the last chunk to the first as in the SQL
    measured = measured.withColumn("rows", F.sort_array("rows", asc=False))
    overlap = mean_in_order(F.col("rows.overlap"))
    measured = measured.withColumns({"completeness": mean_in_order(F.col("rows.completeness")), "coherence": mean_in_order(F.col("rows.coherence")), "overlap": F.coalesce(overlap, F.lit(1.0)), "redundancy": F.coalesce(overlap, F.lit(0.0))}).drop("rows")
    return measured.join(metadata.select("doc_id", F.col("rich").alias("metadata_richness")), "doc_id")


#: Measure, its threshold, advice, expected improvement.
ADVICE = (("completeness", 0.7, "increase chunk size", 0.2), ("coherence", 0.6, "keep sentences together", 0.15), ("redundancy", -0.3, "reduce overlap", 0.1), ("structure", 0.5, "preserve structure", 0.12))
_ADVICE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{m}' AS measure, '{text}' AS advice, {gain}e0 AS improvement FROM measured WHERE {m} {'>' if t < 0 else '<'} {abs(t)}" for m, t, text, gain in ADVICE
)


@query("q16_recommendations", f"WITH {DUCK_CHUNKS}, {_PAIRS}, {_REPORT_SQL} {_ADVICE_SQL}")
def recommendations(spark, sf_dir):
    rows = F.array(*[F.when((F.col(m) > -t) if t < 0 else (F.col(m) < t), F.struct(F.lit(m).alias("measure"), F.lit(text).alias("advice"), F.lit(gain).alias("improvement"))) for m, t, text, gain in ADVICE])
    return document_measures(chunks(spark, sf_dir), files(spark, sf_dir)).select("doc_id", F.explode(F.array_compact(rows)).alias("x")).select("doc_id", "x.*")


_KIND = f"""CASE WHEN {_T} = '' THEN 'text' WHEN starts_with({_T}, '```') OR {_ANY(_T, ['function ', 'class ', 'def ', 'public ', 'private '])} THEN 'code'
 WHEN len(list_filter(string_split({_T}, chr(10)), lambda x: contains(x, '|'))) >= 2 THEN 'table'
 WHEN regexp_matches({_T}, '^(?:- |\\* |1\\. )') OR len(list_filter(string_split({_T}, chr(10)), lambda x: starts_with(ltrim(x), '- '))) >= 2 THEN 'list'
 WHEN starts_with({_T}, '#') OR (length({_T}) < 100 AND len(string_split({_T}, chr(10))) = 1 AND {_UPPER(_T)}) THEN 'heading' ELSE 'text' END"""


@query(
    "q20_content_type",
    f"WITH {DUCK_DECORATED}, k AS (SELECT doc_id, i, {_KIND} AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS content, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS i FROM decorated)) "
    "SELECT doc_id, i, kind, CASE kind WHEN 'heading' THEN 'title' WHEN 'code' THEN 'code_block' WHEN 'table' THEN 'table_content' WHEN 'list' THEN 'list_content' ELSE 'content' END AS role, "
    "concat_ws(' | ', 'Document: Technical', 'Section: ' || doc_id, CASE WHEN kind <> 'text' THEN 'Type: ' || kind END) AS header FROM k",
)
def content_types(spark, sf_dir):
    """Q20, Q23: kind and role of each paragraph, and its contextual header."""
    parts = decorated(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("i", "content")).withColumn("kind", S.content_type(F.col("content")))
    header = F.concat_ws(" | ", F.lit("Document: Technical"), F.concat(F.lit("Section: "), F.col("doc_id").cast("string")), F.when(F.col("kind") != "text", F.concat(F.lit("Type: "), "kind")))
    return parts.select("doc_id", "i", "kind", S.role(F.col("kind")).alias("role"), header.alias("header"))


_TOPIC = lambda terms: f"round(CASE WHEN len({_WL}) > 0 THEN len(list_filter({_WL}, lambda w: w IN {_IN(terms.split())})) / len({_WL}) ELSE 0e0 END, 6)"


@query("q21_topic_scores", f"WITH {DUCK_CHUNKS} SELECT doc_id, chunk_index, " + ", ".join(f"{_TOPIC(terms)} AS {t.lower()}" for d in S.TOPICS.values() for t, terms in d.items()) + " FROM chunks")
def topic_scores(spark, sf_dir):
    scored = {t.lower(): x for d in S.TOPICS for t, x in S.topic_scores(F.col("content"), d).items()}
    return chunks(spark, sf_dir).select("doc_id", "chunk_index", *[F.round(x, 6).alias(t) for t, x in scored.items()])


#: Technical vocabulary.
VOCABULARY = "API REST GRAPHQL JSON XML HTTP HTTPS SSL TLS JWT OAUTH SQL NOSQL MONGODB POSTGRESQL MYSQL DOCKER KUBERNETES AWS AZURE GCP CI/CD DEVOPS".split()


#: The letters whose upper case is ASCII, letter by letter as in DuckDB: Java's makes two of some (SS of a sharp s).
_LETTERS = "abcdefghijklmnopqrstuvwxyz\u0131\u017f", "ABCDEFGHIJKLMNOPQRSTUVWXYZIS"


_TECH = "CASE (doc_id + chunk_index) % 5 WHEN 0 THEN 'A REST api (json) over https; ' WHEN 1 THEN 'sql, docker. Sql! CI/CD ' WHEN 2 THEN 'rest rests sqlite ' ELSE '' END"


@query(
    "q22_technical_keywords",
    f"WITH {DUCK_CHUNKS} SELECT doc_id, chunk_index, array_to_string(list_sort(list_distinct(list_filter(list_transform({_W}, lambda w: upper(trim(w, '(),.!?;:'))), lambda w: w IN {_IN(VOCABULARY)}))), ',') AS keywords FROM (SELECT doc_id, chunk_index, {_TECH} || content AS content FROM chunks)",
)
def technical_keywords(spark, sf_dir):
    """Vocabulary words of each chunk; technical words are put before some of them, as texts here hold none."""
    clean = F.transform(S.words(F.col("content")), lambda w: F.translate(F.btrim(w, F.lit("(),.!?;:")), *_LETTERS))
    found = F.array_sort(F.array_distinct(F.filter(clean, lambda w: w.isin(VOCABULARY))))
    return chunks(spark, sf_dir).withColumn("content", F.concat(F.expr(_TECH), "content")).select("doc_id", "chunk_index", F.array_join(found, ",").alias("keywords"))
