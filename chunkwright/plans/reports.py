"""Run statistics, document aggregates and evaluation reports over chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chunkwright.functions import scores as S
from chunkwright.operators.heavy import most_frequent, top_words
from chunkwright.plans.corpora import DUCK_CHUNKS, chunks, table
from chunkwright.plans.registry import query

_T = "trim(content, ' ' || chr(9) || chr(13) || chr(10))"


@query(
    "k03_chunk_statistics",
    f"WITH {DUCK_CHUNKS} SELECT doc_id, count(*) AS n, sum(length(content)) AS total, sum(length(content)) // count(*) AS average, min(length(content)) AS least, max(length(content)) AS most, round(max(length(content)) / min(length(content)), 2) AS variance_ratio, max(length(content)) / min(length(content)) <= 3 AS balanced FROM chunks GROUP BY doc_id",
)
def chunk_statistics(spark, sf_dir):
    size = F.length("content")
    ratio = F.max(size) / F.min(size)
    return chunks(spark, sf_dir).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(size).alias("total"), F.floor(F.sum(size) / F.count("*")).alias("average"), F.min(size).alias("least"), F.max(size).alias("most"), F.round(ratio, 2).alias("variance_ratio"), (ratio <= 3).alias("balanced")
    )


def _words(text: str):
    """Words of four letters or more, lower-cased."""
    return F.filter(F.transform(F.split(text, r"\W+"), F.lower), lambda w: F.length(w) > 3)


@query(
    "k04_document_summary",
    """WITH w AS (SELECT source, lower(unnest(string_split_regex(text, '\\W+'))) AS w FROM documents), c AS (SELECT source, w, count(*) AS n FROM w WHERE length(w) > 3 GROUP BY 1, 2),
    k AS (SELECT source, string_agg(w, ',' ORDER BY n DESC, w) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS rank FROM c) WHERE rank <= 20 GROUP BY source),
    f AS (SELECT source, count(*) AS n_docs, substr(arg_min(text, doc_id), 1, 200) || '...' AS summary FROM documents GROUP BY source) SELECT f.source, n_docs, summary, keywords FROM f JOIN k USING (source)""",
)
def document_summary(spark, sf_dir):
    """By source, the twenty most frequent words and the first text's beginning. Tasks keep bounded counters; words that may be among the first twenty are counted exactly."""
    docs = table(spark, sf_dir, "documents")
    grouped = docs.select(F.col("source").alias("grp"), _words("text").alias("words"))
    top = top_words(grouped, 20).groupBy(F.col("grp").alias("source")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "w")))["w"], ",").alias("keywords"))
    first = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.concat(F.substring(F.min_by("text", "doc_id"), 1, 200), F.lit("...")).alias("summary"))
    return first.join(top, "source").select("source", "n_docs", "summary", "keywords")


_DUCK_TOP = lambda text, k: f"list_transform(list_sort(list_transform(map_entries(list_histogram(list_filter(list_transform(string_split_regex({text}, '\\W+'), lambda w: lower(w)), lambda w: length(w) > 3))), lambda e: {{'n': -CAST(e.value AS BIGINT), 'w': e.key}}))[1:{k}], lambda x: x.w)"


@query("k04_document_keywords", f"SELECT doc_id, coalesce(array_to_string({_DUCK_TOP('text', 20)}, ','), '') AS keywords, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS summary FROM documents WHERE text IS NOT NULL")
def document_keywords(spark, sf_dir):
    """Each document's twenty most frequent words and its beginning, within its row."""
    beginning = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(most_frequent(_words("text"), 20), ",").alias("keywords"), beginning.alias("summary"))


@query("k05_result_paths", "SELECT doc_id, sha256(text) AS digest, 'results/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) || '.json' AS path FROM documents WHERE text IS NOT NULL")
def result_paths(spark, sf_dir):
    h = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", h.alias("digest"), F.concat(F.lit("results/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"), h, F.lit(".json")).alias("path"))


@query("k06_size_histogram", f"WITH {DUCK_CHUNKS} SELECT least(length(content) // 200, 9) AS bucket, count(*) AS n FROM chunks GROUP BY 1")
def size_histogram(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy(F.expr("least(length(content) div 200, 9)").alias("bucket")).agg(F.count("*").alias("n"))


@query("k08_store_insert", "SELECT digest, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT sha256(text) AS digest, doc_id FROM documents WHERE text IS NOT NULL) WHERE digest NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0 AND text IS NOT NULL) GROUP BY digest")
def store_insert(spark, sf_dir):
    """Texts that a store (the documents with ids divisible by 10) doesn't hold yet, once each."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.join(docs.where("doc_id % 10 = 0").select("digest"), "digest", "left_anti").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "k09_enrichment_index",
    f"""WITH {DUCK_CHUNKS}, c AS (SELECT doc_id, chunk_index, content, length(content) > 500 AS enriched, CASE WHEN length(content) > 500 THEN {_DUCK_TOP('content', 5)} ELSE [] END AS k FROM chunks), kw AS (SELECT doc_id, chunk_index, unnest(k) AS w, generate_subscripts(k, 1) AS i FROM c),
    f AS (SELECT doc_id, w, min(chunk_index * 10 + i) AS at_first FROM kw GROUP BY 1, 2), t AS (SELECT doc_id, string_agg(w, ',' ORDER BY at_first) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY at_first) AS r FROM f) WHERE r <= 20 GROUP BY doc_id)
    SELECT c.doc_id, count(*) AS n, round(100e0 * count(*) FILTER (WHERE enriched) / count(*), 1) AS rate, string_agg(substr(content, 1, 300), '|' ORDER BY chunk_index) FILTER (WHERE enriched AND chunk_index < 3) AS summaries, coalesce(any_value(keywords), '') AS keywords,
    md5(string_agg(CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END, '|' ORDER BY chunk_index)) AS previews FROM c LEFT JOIN t USING (doc_id) GROUP BY c.doc_id""",
)
def enrichment_index(spark, sf_dir):
    """Share of enriched chunks, first summaries, twenty keywords in the order of their appearance (five a chunk), previews."""
    enriched = F.length("content") > 500
    own = chunks(spark, sf_dir).select("doc_id", "chunk_index", "content", enriched.alias("enriched"), F.when(enriched, most_frequent(_words("content"), 5)).otherwise(F.array().cast("array<string>")).alias("k"))
    first = F.collect_list(F.when(F.col("enriched") & (F.col("chunk_index") < 3), F.struct("chunk_index", F.substring("content", 1, 300).alias("s"))))
    preview = F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))).otherwise(F.col("content"))
    out = own.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.round(100.0 * F.count_if("enriched") / F.count("*"), 1).alias("rate"), F.array_sort(first)["s"].alias("s"),
        F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct("chunk_index", "k")))["k"])).alias("k"), F.array_join(F.array_sort(F.collect_list(F.struct("chunk_index", preview.alias("p"))))["p"], "|").alias("p"),
    )
    return out.select("doc_id", "n", "rate", F.when(F.size("s") > 0, F.array_join("s", "|")).alias("summaries"), F.array_join(F.slice("k", 1, 20), ",").alias("keywords"), F.md5("p").alias("previews"))


@query("k10_estimates", "SELECT doc_id, length(text) // 5 AS words, length(text) // 4 AS tokens FROM documents")
def estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("length(text) div 5").alias("words"), F.expr("length(text) div 4").alias("tokens"))


_SENT = "list_filter(list_transform(string_split_regex(content, '[.!?。]'), lambda s: trim(s, ' ' || chr(9) || chr(13) || chr(10))), lambda s: s <> '')"
_BAD = f"(CAST(regexp_matches({_T}, '[\\p{{L}}\\p{{Nd}},]\\z') AS INT) + CAST(contains(content, '...') AND NOT contains(content, 'etc.') AS INT) + CAST(regexp_matches({_SENT}[1], '\\A\\p{{Ll}}') AS INT))"


@query("e03_completeness", f"WITH {DUCK_CHUNKS} SELECT doc_id, chunk_index, len({_SENT}) AS sentences, CASE WHEN len({_SENT}) > 0 THEN {_BAD} ELSE 0 END AS incomplete, round(CASE WHEN len({_SENT}) > 0 THEN (len({_SENT}) - {_BAD}) / len({_SENT}) ELSE 0e0 END, 6) AS score FROM chunks")
def completeness(spark, sf_dir):
    c = F.col("content")
    s = F.filter(F.transform(F.split(c, "[.!?。]"), S.trimmed), lambda x: x != "")
    n = F.size(s)
    bad = F.when(n > 0, S.trimmed(c).rlike(r"[\p{L}\p{Nd},]\z").cast("int") + (c.contains("...") & ~c.contains("etc.")).cast("int") + F.try_element_at(s, F.lit(1)).rlike(r"\A\p{Ll}").cast("int")).otherwise(0)
    return chunks(spark, sf_dir).select("doc_id", "chunk_index", n.alias("sentences"), bad.alias("incomplete"), F.round(F.when(n > 0, (n - bad) / n).otherwise(0.0), 6).alias("score"))


HEAD = 12


@query(
    "e04_suffix_overlap",
    f"WITH {DUCK_CHUNKS}, p AS (SELECT doc_id, chunk_index, content, lead(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS next FROM chunks) "
    "SELECT doc_id, chunk_index, overlap, overlap // 4 AS tokens, abs(overlap - 128) <= 25.6 AS effective FROM (SELECT doc_id, chunk_index, coalesce(list_max(list_filter(range(1, CAST(least(length(content), length(next)) + 1 AS BIGINT)), lambda k: right(content, k) = left(next, k))), 0) AS overlap FROM p WHERE next IS NOT NULL)",
)
def suffix_overlap(spark, sf_dir):
    """The longest end of a chunk that starts the next one."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    p = chunks(spark, sf_dir).withColumn("next", F.lead("content").over(w)).where("next IS NOT NULL")
    # an end of HEAD characters or more begins where the chunk holds the next one's first HEAD; shorter ones are tried one by one
    quoted = F.replace(F.left("next", F.lit(HEAD)), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    p = p.withColumn("pieces", F.transform(F.split("content", F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)")), -1), F.length))
    longest = F.expr(
        f"""coalesce(array_max(filter(concat(sequence(1, {HEAD - 1}), transform(sequence(1, size(pieces)), i -> aggregate(slice(pieces, i, size(pieces)), 0, (a, x) -> a + x))),
          k -> k <= least(length(content), length(next)) AND right(content, k) = left(next, k))), 0)"""
    )
    p = p.select("doc_id", "chunk_index", longest.alias("overlap"))
    return p.select("doc_id", "chunk_index", "overlap", F.expr("overlap div 4").alias("tokens"), (F.abs(F.col("overlap") - 128) <= 25.6).alias("effective"))


@query("e08_length_profile", "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, round(stddev_pop(length(text)), 6) AS sd, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.95), 6) AS p95, round(quantile_cont(length(text), 0.99), 6) AS p99 FROM documents GROUP BY lang")
def length_profile(spark, sf_dir):
    n = F.length("text")
    p = F.percentile(n, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("sd"), p.alias("p")).select(
        "lang", "n", "mean", "sd", *[F.round(F.col("p")[i], 6).alias(name) for i, name in enumerate(("p50", "p95", "p99"))]
    )


@query(
    "e06c_entropy",
    f"WITH {DUCK_CHUNKS}, w AS (SELECT doc_id, chunk_index, lower(unnest(list_filter(string_split(content, ' '), lambda w: w <> ''))) AS w FROM chunks), c AS (SELECT doc_id, chunk_index, w, count(*) AS n FROM w GROUP BY 1, 2, 3), t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, chunk_index) AS total FROM c) "
    "SELECT doc_id, chunk_index, count(*) AS vocabulary, round(-sum(n / total * log2(n / total)), 6) + 0e0 AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(n / total * log2(n / total)) / log2(count(*)) ELSE 0e0 END, 6) AS normalised FROM t GROUP BY 1, 2",
)
def entropy(spark, sf_dir):
    """By the identity sum p log p = (sum n log n) / N - log N, so one pass of counts serves."""
    w = chunks(spark, sf_dir).select("doc_id", "chunk_index", F.explode(S.words(F.col("content"))).alias("w"))
    c = w.groupBy("doc_id", "chunk_index", F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    g = c.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("vocabulary"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))
    positive = F.greatest(F.lit(0.0), F.round("h", 6))
    return g.select("doc_id", "chunk_index", "vocabulary", positive.alias("entropy"), F.greatest(F.lit(0.0), F.round(F.when(F.col("vocabulary") > 1, F.col("h") / F.log2("vocabulary")).otherwise(0.0), 6)).alias("normalised"))


@query(
    "e06g_duplicates",
    f"WITH {DUCK_CHUNKS} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE copies > 1) AS repeated, round(1e0 - count(*) FILTER (WHERE copies > 1) / count(*), 6) AS unique_share FROM (SELECT doc_id, count(*) OVER (PARTITION BY content) AS copies FROM chunks) GROUP BY doc_id",
)
def duplicates(spark, sf_dir):
    """Copies are counted by content before they are joined back, so a frequent chunk isn't gathered."""
    c = chunks(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("k"))
    repeated = c.groupBy("k").agg(F.count("*").alias("copies")).where("copies > 1")
    return c.join(repeated, "k", "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("copies").alias("repeated"), F.round(1 - F.count("copies") / F.count("*"), 6).alias("unique_share"))


_Q_WORDS = "list_filter(string_split_regex(content, '[ \\t\\n\\r]'), lambda w: w <> '')"
_Q_SENTENCES = f"len(list_filter(string_split_regex({_T}, '[.!?]'), lambda s: length(trim(s, ' ' || chr(9) || chr(13) || chr(10))) > 10))"
_Q_POINTS = f"(CAST(regexp_matches({_T}, '[.!?:]$') AS INT) + CAST(length({_T}) > 50 AS INT) + CAST({_Q_SENTENCES} > 1 AS INT) + CAST(regexp_matches({_T}, '^\\p{{Lu}}') AS INT))"


@query(
    "e10_quick_score",
    f"""WITH {DUCK_CHUNKS}, b AS (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before, {_Q_WORDS} AS w FROM chunks), k AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(before), length(content), 256) + 1), lambda k: right(before, k) = left(content, k))), 0) AS k, least(128, least(length(before), length(content)) // 4) AS want FROM b),
    o AS (SELECT *, CASE WHEN before IS NULL THEN NULL WHEN k = 0 THEN 0e0 ELSE least(1e0, CASE WHEN want = 0 THEN 1e0 ELSE least(1e0, k / want) END * CASE WHEN regexp_matches(left(content, CAST(k AS BIGINT)), '[.!?]') THEN 1.2e0 ELSE 1e0 END) END AS lap FROM k),
    m AS (SELECT doc_id, avg(CASE WHEN {_Q_POINTS} >= 3 THEN 1e0 ELSE 0e0 END) AS complete, coalesce(avg(lap), 0e0) AS overlap, coalesce(avg(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) > 2)) / len(w) END), 0e0) AS density FROM o GROUP BY doc_id)
    SELECT doc_id, round(complete, 6) AS complete, round(overlap, 6) AS overlap, round(density, 6) AS density, round(0.4e0 * complete + 0.3e0 * overlap + 0.3e0 * density, 6) AS overall FROM m""",
)
def quick_score(spark, sf_dir):
    """Chunks that look complete, overlap against what is expected (more if it holds a sentence end), density of words, and their weighted sum."""
    c = F.col("content")
    t = S.trimmed(c)
    full = F.size(F.filter(F.split(t, "[.!?]"), lambda s: F.length(S.trimmed(s)) > 10)) > 1
    points = t.rlike(r"[.!?:]\z").cast("int") + (F.length(t) > 50).cast("int") + full.cast("int") + t.rlike(r"\A\p{Lu}").cast("int")
    found = chunks(spark, sf_dir).withColumns({"before": F.lag("content").over(Window.partitionBy("doc_id").orderBy("chunk_index")), "w": F.filter(F.split(c, r"[ \t\n\r]"), lambda w: w != "")})
    lap = F.expr("transform(array(struct(right(before, 256) AS b, left(content, 256) AS h)), x -> coalesce(array_max(filter(sequence(1, least(length(x.b), length(x.h))), k -> right(x.b, k) = left(x.h, k))), 0))[0]")
    found = found.withColumns({"k": F.when(F.col("before").isNotNull(), lap), "want": F.expr("least(128, least(length(before), length(content)) div 4)")})
    share = F.when(F.col("want") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("k") / F.col("want"))) * F.when(F.left(c, F.col("k")).rlike("[.!?]"), 1.2).otherwise(1.0)
    score = F.when(F.col("k") == 0, 0.0).when(F.col("k") > 0, F.least(F.lit(1.0), share))
    dense = F.when(F.size("w") > 0, F.size(F.filter("w", lambda x: F.length(x) > 2)) / F.size("w"))
    m = found.groupBy("doc_id").agg(F.avg(S.number(points >= 3)).alias("complete"), F.coalesce(F.avg(score), F.lit(0.0)).alias("overlap"), F.coalesce(F.avg(dense), F.lit(0.0)).alias("density"))
    return m.select("doc_id", *[F.round(x, 6).alias(x) for x in ("complete", "overlap", "density")], F.round(F.expr("0.4D * complete + 0.3D * overlap + 0.3D * density"), 6).alias("overall"))


@query("p04_batch_summary", "SELECT count(*) AS processed, count(*) FILTER (WHERE length(text) > 0) AS succeeded, count(*) FILTER (WHERE text IS NULL OR length(text) = 0) AS failed, CAST(sum(coalesce(ceil(length(text) / 1024.0), 0)) AS BIGINT) AS total_chunks FROM documents")
def batch_summary(spark, sf_dir):
    ok = F.coalesce(F.length("text") > 0, F.lit(False))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("processed"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.sum(F.coalesce(F.ceil(F.length("text") / 1024.0), F.lit(0))).cast("long").alias("total_chunks"))


@query("p07_cache_keys", "SELECT doc_id, substr(sha256(source || '|' || doc_id || '|' || length(text) || '|opts'), 1, 16) AS cache_key FROM documents WHERE text IS NOT NULL")
def cache_keys(spark, sf_dir):
    parts = F.concat_ws("|", "source", F.col("doc_id").cast("string"), F.length("text").cast("string"), F.lit("opts"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.substring(F.sha2(parts, 256), 1, 16).alias("cache_key"))


@query(
    "u05_refine_gates",
    "SELECT doc_id, regexp_matches(text, '[a-z,]\\n[a-z]') AS restore, length(text) >= 500 AS noise, regexp_matches(text, '[|]{2,}|[0O]{3,}|\\brn\\b') AS ocr, regexp_matches(text, '(?m)^#{1,6} ') AS restructure, length(text) >= 1000 AS merge, "
    "least(1e0, 0.2e0 * (CAST(regexp_matches(text, '[a-z,]\\n[a-z]') AS INT) + CAST(length(text) >= 500 AS INT) + CAST(regexp_matches(text, '(?m)^#{1,6} ') AS INT) + CAST(length(text) >= 1000 AS INT))) AS improvement FROM documents WHERE text IS NOT NULL",
)
def refine_gates(spark, sf_dir):
    """Which model steps a text calls for, judged before any model runs."""
    t = F.col("text")
    broken, noisy, ocr, headed, long_ = t.rlike(r"[a-z,]\n[a-z]"), F.length(t) >= 500, t.rlike(r"[|]{2,}|[0O]{3,}|\brn\b"), t.rlike("(?dm)^#{1,6} "), F.length(t) >= 1000
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        "doc_id", broken.alias("restore"), noisy.alias("noise"), ocr.alias("ocr"), headed.alias("restructure"), long_.alias("merge"),
        F.least(F.lit(1.0), 0.2 * (broken.cast("int") + noisy.cast("int") + headed.cast("int") + long_.cast("int"))).alias("improvement"),
    )


@query("s01_text_hints", "SELECT doc_id, length(text) AS character_count, len(string_split(text, chr(10))) AS line_count, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> '')) AS paragraph_count, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS word_count, length(text) < 30 AS short_warning FROM documents WHERE text IS NOT NULL")
def text_hints(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        "doc_id", F.length(t).alias("character_count"), F.size(F.split(t, "\n")).alias("line_count"), F.size(F.filter(F.split(t, "\n\n"), lambda p: F.trim(p) != "")).alias("paragraph_count"),
        F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).alias("word_count"), (F.length(t) < 30).alias("short_warning"),
    )


@query(
    "s05_table_markdown",
    "SELECT '| r_regionkey | n_nationkey | n_name |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_regionkey || ' | ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |', chr(10) ORDER BY n_nationkey) AS markdown, count(*) AS row_count, 3 AS column_count, n_regionkey FROM nation GROUP BY n_regionkey",
)
def table_markdown(spark, sf_dir):
    """Rows of a table, by group, as a markdown table."""
    row = F.concat(F.lit("| "), F.col("n_regionkey").cast("string"), F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.replace("n_name", F.lit("|"), F.lit("\\|")), F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row"))))["row"]
    head = "| r_regionkey | n_nationkey | n_name |\n| --- | --- | --- |\n"
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit(head), F.array_join(rows, "\n")).alias("markdown"), F.count("*").alias("row_count"), F.lit(3).alias("column_count"))


@query("s17_file_names", "SELECT page_id, string_split_regex(split_part(split_part(url, '?', 1), '#', 1), '[/\\\\]')[-1] AS name FROM pages")
def file_names(spark, sf_dir):
    clean = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.split(clean, r"[/\\]"), -1).alias("name"))


@query("s04d_links", "SELECT page_id, len(regexp_extract_all(html, '<a\\s[^>]*href=')) AS links, len(regexp_extract_all(html, '<a\\s[^>]*href=\"https?://')) AS external_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def links(spark, sf_dir):
    n = lambda p, name: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).alias(name)
    return table(spark, sf_dir, "pages").select("page_id", n(r"<a\s[^>]*href=", "links"), n(r'<a\s[^>]*href="https?://', "external_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), n("<p>", "paragraphs"))
