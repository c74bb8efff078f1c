"""Vector, boundary and coherence queries over the embeddings: a label is a document, vec_id the order of its segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chunkwright.operators import vectors as V
from chunkwright.operators.containment import either_way
from chunkwright.operators.ordered import running_sum, stored
from chunkwright.plans.corpora import table
from chunkwright.plans.registry import query


def segments(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("i"), "embedding")


@query(
    "v03_top_k",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT query_id, vec_id, list_cosine_similarity(q.e, v.e) AS score FROM q, v)
    SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def top_k(spark, sf_dir):
    """The vectors whose id is divisible by 100 against all vectors."""
    vecs = table(spark, sf_dir, "embeddings")
    queries = vecs.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.top_k(queries, vecs, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_SIM = """s AS (SELECT label AS doc_id, vec_id AS i, list_cosine_similarity(embedding::DOUBLE[], (lead(embedding) OVER (PARTITION BY label ORDER BY vec_id))::DOUBLE[]) AS similarity FROM embeddings)"""


@query(
    "b01_semantic_boundaries",
    f"WITH {_SIM} SELECT doc_id, i, round(similarity, 6) AS similarity, round(least(1e0, 2 * abs(similarity - 0.7)), 6) AS confidence, CASE WHEN similarity < 0.5 THEN 'TopicChange' ELSE 'Sentence' END AS kind FROM s WHERE similarity < 0.7",
)
def semantic_boundaries(spark, sf_dir):
    s = V.neighbour_similarity(segments(spark, sf_dir)).where("similarity < 0.7")
    confidence = F.least(F.lit(1.0), 2 * F.abs(F.col("similarity") - 0.7))
    return s.select("doc_id", "i", F.round("similarity", 6).alias("similarity"), F.round(confidence, 6).alias("confidence"), F.when(F.col("similarity") < 0.5, "TopicChange").otherwise("Sentence").alias("kind"))


@query(
    "b04_merged_boundaries",
    f"""WITH RECURSIVE {_SIM}, b AS (SELECT doc_id, i, round(least(1e0, 2 * abs(similarity - 0.7)), 9) AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS z FROM s WHERE similarity < 0.7),
    r AS (SELECT doc_id, k, i AS last_i, confidence AS last_c, k AS grp FROM b WHERE k = 1 UNION ALL
      SELECT b.doc_id, b.k, CASE WHEN b.i - r.last_i > 2 OR b.confidence > r.last_c THEN b.i ELSE r.last_i END, CASE WHEN b.i - r.last_i > 2 OR b.confidence > r.last_c THEN b.confidence ELSE r.last_c END,
        CASE WHEN b.i - r.last_i > 2 THEN b.k ELSE r.grp END FROM r JOIN b ON b.doc_id = r.doc_id AND b.k = r.k + 1)
    SELECT doc_id, last_i AS i, round(last_c, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY k DESC) AS last FROM r) WHERE last = 1""",
)
def merged_boundaries(spark, sf_dir):
    s = V.neighbour_similarity(segments(spark, sf_dir)).where("similarity < 0.7")
    b = s.select("doc_id", "i", F.round(F.least(F.lit(1.0), 2 * F.abs(F.col("similarity") - 0.7)), 9).alias("confidence"))
    return V.merge_nearby(b).select("doc_id", "i", F.round("confidence", 6).alias("confidence"))


_SEG = """seg AS (SELECT conv_id AS doc_id, turn AS i, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS next FROM conversations)"""
_SET = lambda x: f"list_distinct(list_filter(string_split(lower({x}), ' '), lambda w: length(w) > 2))"
_U = f"len(list_distinct(list_concat({_SET('text')}, {_SET('next')})))"


@query(
    "b02_text_boundaries",
    f"""WITH {_SEG}, s AS (SELECT doc_id, i, text, next, CASE WHEN {_U} = 0 THEN 1e0 WHEN len({_SET('text')}) = 0 OR len({_SET('next')}) = 0 THEN 0e0 ELSE len(list_intersect({_SET('text')}, {_SET('next')})) / {_U} END AS similarity FROM seg WHERE next IS NOT NULL)
    SELECT doc_id, i, round(similarity, 6) AS similarity, round(least(1e0, 1.5e0 * abs(similarity - 0.56)), 6) AS confidence, CASE WHEN starts_with(next, '#') THEN 'Section' WHEN contains(next, '```') THEN 'CodeBlock' WHEN length(next) - length(replace(next, '|', '')) > 2 THEN 'Table'
     WHEN regexp_matches(next, '(?m)^\\s*(?:[-*+•]|\\d+\\.)\\s+') THEN 'List' WHEN similarity < 0.5 THEN 'TopicChange' ELSE 'Sentence' END AS kind FROM s WHERE similarity < 0.56""",
)
def text_boundaries(spark, sf_dir):
    from chunkwright.functions.scores import jaccard

    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda x: F.length(x) > 2))
    t = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(w)).where("next IS NOT NULL")
    t = t.withColumn("similarity", jaccard(words(F.col("text")), words(F.col("next")))).where("similarity < 0.56")
    nxt = F.col("next")
    kind = (
        F.when(nxt.startswith("#"), "Section").when(nxt.contains("```"), "CodeBlock").when(F.length(nxt) - F.length(F.replace(nxt, F.lit("|"), F.lit(""))) > 2, "Table")
        .when(nxt.rlike(r"(?dm)^\s*(?:[-*+•]|\d+\.)\s+"), "List").when(F.col("similarity") < 0.5, "TopicChange").otherwise("Sentence")
    )
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("i"), F.round("similarity", 6).alias("similarity"), F.round(F.least(F.lit(1.0), 1.5 * F.abs(F.col("similarity") - 0.56)), 6).alias("confidence"), kind.alias("kind"))


_OWN, _BEFORE = "list_filter(string_split(lower(text), ' '), lambda w: w <> '')", "list_filter(string_split(lower(before), ' '), lambda w: w <> '')"
_UNCERTAIN = f"""(20e0 * CASE WHEN before IS NULL THEN 2e0 ELSE 2 - (CASE WHEN len({_OWN}) > 0 THEN len(list_filter({_OWN}, lambda w: list_contains({_BEFORE}, w))) / len({_OWN}) ELSE 0e0 END) END
 * CASE WHEN starts_with(text, '#') OR contains(text, 'Chapter') OR contains(text, 'Section') THEN 1.5e0 ELSE 1e0 END * CASE WHEN contains(text, '```') OR contains(text, 'def ') OR contains(text, 'function ') THEN 1.8e0 ELSE 1e0 END
 * CASE WHEN length(text) - length(replace(text, '|', '')) > 3 THEN 1.6e0 ELSE 1e0 END * CASE WHEN len({_OWN}) > 0 AND list_sum(list_transform({_OWN}, lambda w: length(w))) / len({_OWN}) > 6 THEN 1.2e0 ELSE 1e0 END)"""


@query(
    "b08_hybrid_boundaries",
    f"""WITH {_SEG}, u AS (SELECT doc_id, i, text, before, greatest(1e0, least(1000e0, {_UNCERTAIN})) AS u, CASE WHEN before IS NULL OR len(list_distinct(list_concat({_OWN}, {_BEFORE}))) = 0 THEN 1e0 ELSE len(list_intersect(list_distinct({_OWN}), list_distinct({_BEFORE}))) / len(list_distinct(list_concat({_OWN}, {_BEFORE}))) END AS sim FROM seg),
    h AS (SELECT *, least(1e0, greatest(0e0, log10(u) / 3)) AS stat FROM u)
    SELECT doc_id, i, round(u, 6) AS uncertainty, round(u - coalesce(lag(u) OVER (PARTITION BY doc_id ORDER BY i, text), u), 6) AS delta, round(0.6e0 * stat + 0.4e0 * (1 - sim), 6) AS hybrid, 0.6e0 * stat + 0.4e0 * (1 - sim) > 0.7 AS is_boundary, round(0.6e0 * (1 - abs(stat - (1 - sim))) + 0.4e0 * abs(0.6e0 * stat + 0.4e0 * (1 - sim) - 0.7), 6) AS confidence FROM h""",
)
def hybrid_boundaries(spark, sf_dir):
    """B05, B07-B09 with the deterministic uncertainty: statistics and word overlap of each turn with the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    own = lambda c: F.filter(F.split(F.lower(c), " "), lambda x: x != "")
    t = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w))
    text, before = F.col("text"), F.col("before")
    a, b = own(text), own(before)
    n = F.size(a)
    known = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    has = lambda *terms: F.lit(False) if not terms else text.contains(terms[0]) | has(*terms[1:])
    factor = lambda cond, by: F.when(cond, by).otherwise(1.0)
    u = (
        F.lit(20.0) * F.when(before.isNull(), 2.0).otherwise(2 - F.when(n > 0, known / n).otherwise(0.0)) * factor(text.startswith("#") | has("Chapter", "Section"), 1.5)
        * factor(has("```", "def ", "function "), 1.8) * factor(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) > 3, 1.6)
        * factor((n > 0) & (F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x)) / n > 6), 1.2)
    )
    union = F.size(F.array_union(a, b))
    t = t.withColumn("u", F.greatest(F.lit(1.0), F.least(F.lit(1000.0), u))).withColumn("sim", F.when(before.isNull() | (union == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / union))
    t = t.withColumn("stat", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10("u") / 3))).withColumn("h", 0.6 * F.col("stat") + 0.4 * (1 - F.col("sim")))
    r = lambda c, name: F.round(c, 6).alias(name)
    delta = F.col("u") - F.coalesce(F.lag("u").over(w), F.col("u"))
    return t.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("i"), r(F.col("u"), "uncertainty"), r(delta, "delta"), r(F.col("h"), "hybrid"), (F.col("h") > 0.7).alias("is_boundary"),
        r(0.6 * (1 - F.abs(F.col("stat") - (1 - F.col("sim")))) + 0.4 * F.abs(F.col("h") - 0.7), "confidence"),
    )


@query(
    "q25_coherence",
    """WITH e AS (SELECT label AS doc_id, vec_id // 10 AS chunk, vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.doc_id, a.chunk, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.chunk = b.chunk AND a.vec_id < b.vec_id),
    c AS (SELECT doc_id, chunk, count(*) AS pairs, avg(sim) AS mean, stddev_pop(sim) AS sd, count(*) FILTER (WHERE sim < 0.3) AS weak FROM p GROUP BY 1, 2)
    SELECT doc_id, chunk, pairs, round(mean, 6) AS mean, round(sd, 6) AS sd, weak, round(greatest(0e0, mean * (1 - 0.5e0 * sd)), 6) AS score, greatest(0e0, mean * (1 - 0.5e0 * sd)) < 0.8 * avg(greatest(0e0, mean * (1 - 0.5e0 * sd))) OVER () AS outlier FROM c""",
)
def coherence(spark, sf_dir):
    """Q25-Q27: pairwise similarity inside chunks of up to ten segments, spread, weak pairs and outliers."""
    e = segments(spark, sf_dir).withColumn("chunk", F.expr("i div 10"))
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.chunk") == F.col("b.chunk")) & (F.col("a.i") < F.col("b.i")))
    p = pairs.select("a.doc_id", "a.chunk", V.cosine(F.col("a.embedding"), F.col("b.embedding")).alias("sim"))
    c = p.groupBy("doc_id", "chunk").agg(F.count("*").alias("pairs"), F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("sd"), F.count_if(F.col("sim") < 0.3).alias("weak"))
    c = c.withColumn("score", F.greatest(F.lit(0.0), F.col("mean") * (1 - 0.5 * F.col("sd"))))
    average = c.agg(F.avg("score").alias("average"))
    r = lambda n: F.round(n, 6).alias(n)
    return c.crossJoin(F.broadcast(average)).select("doc_id", "chunk", "pairs", r("mean"), r("sd"), "weak", r("score"), (F.col("score") < 0.8 * F.col("average")).alias("outlier"))  # one row


@query(
    "e05_neighbour_coherence",
    f"WITH {_SIM} SELECT doc_id, round(avg(similarity), 6) AS mean, round(min(similarity), 6) AS least, round(max(similarity), 6) AS most FROM s WHERE similarity IS NOT NULL GROUP BY doc_id",
)
def neighbour_coherence(spark, sf_dir):
    s = V.neighbour_similarity(segments(spark, sf_dir))
    return s.groupBy("doc_id").agg(F.round(F.avg("similarity"), 6).alias("mean"), F.round(F.min("similarity"), 6).alias("least"), F.round(F.max("similarity"), 6).alias("most"))


@query(
    "e01_contained",
    """SELECT item_id, doc_id FROM benchmark b, documents d WHERE b.text <> '' AND d.text <> '' AND (contains(lower(d.text), lower(b.text)) OR contains(lower(b.text), lower(d.text)))""",
)
def contained(spark, sf_dir):
    """E01's relevance: benchmark items and documents of which one contains the other."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return either_way(items, docs).select(F.col("id").alias("item_id"), F.col("other_id").alias("doc_id"))


@query(
    "e01_retrieval",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, lower(text) AS t FROM embeddings JOIN documents ON doc_id = vec_id WHERE text <> ''), q AS (SELECT vec_id AS query_id, label, e FROM v WHERE vec_id % 100 = 0),
    s AS (SELECT q.query_id, q.label AS want, v.t, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id) AS rank FROM q, v),
    n AS (SELECT label, count(*) AS expected FROM v GROUP BY label), j AS (SELECT query_id, want, rank, EXISTS (SELECT 1 FROM v x WHERE x.label = s.want AND (contains(s.t, x.t) OR contains(x.t, s.t))) AS hit FROM s WHERE rank <= 5),
    r AS (SELECT query_id, count(*) FILTER (WHERE hit) AS hits, count(*) AS retrieved, min(rank) FILTER (WHERE hit) AS first, any_value(expected) AS expected FROM j JOIN n ON n.label = j.want GROUP BY query_id)
    SELECT query_id, round(hits / retrieved, 6) AS precision, round(hits / expected, 6) AS recall, round(CASE WHEN hits > 0 THEN 2 * (hits / retrieved) * (hits / expected) / (hits / retrieved + hits / expected) ELSE 0e0 END, 6) AS f1,
     round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(CASE WHEN hits > 0 THEN 1 / row_number() OVER (ORDER BY query_id) ELSE 0e0 END, 6) AS query_place_rank FROM r""",
)
def retrieval(spark, sf_dir):
    """Precision, recall, F1 and reciprocal rank (of the hit, and of the query's place) of the five nearest chunks.

    A vector's chunk is the document of its id; those of the query's label are expected, and a chunk
    is relevant if its text contains an expected one or stands in it.
    """
    docs = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("vec_id"), "text")
    vecs = stored(table(spark, sf_dir, "embeddings").join(docs, "vec_id").select("vec_id", "label", "embedding", "text"))
    queries = vecs.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"), "embedding")
    near = stored(V.top_k(queries, vecs, 5).join(queries.select("query_id", "want"), "query_id").select("query_id", "vec_id", "rank", "want"))
    chunks = vecs.select(F.col("vec_id").alias("id"), "text")
    met = either_way(chunks.join(near.select(F.col("vec_id").alias("id")).distinct(), "id", "left_semi"), chunks.join(vecs.join(near.select(F.col("want").alias("label")).distinct(), "label", "left_semi").select(F.col("vec_id").alias("id")), "id", "left_semi"))
    relevant = met.join(vecs.select(F.col("vec_id").alias("other_id"), F.col("label").alias("want")), "other_id").select(F.col("id").alias("vec_id"), "want").distinct().withColumn("hit", F.lit(True))
    found = near.join(relevant, ["vec_id", "want"], "left").withColumn("hit", F.col("hit").isNotNull())
    sizes = vecs.groupBy(F.col("label").alias("want")).agg(F.count("*").alias("expected"))
    r = found.join(sizes, "want").groupBy("query_id").agg(F.count_if("hit").alias("hits"), F.count("*").alias("retrieved"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.first("expected").alias("expected"))
    p, c = F.col("hits") / F.col("retrieved"), F.col("hits") / F.col("expected")
    # a query's place among all, by a running sum over ranges of ids
    r = running_sum(r.withColumns({"all": F.lit(0), "one": F.lit(1)}), "all", "query_id", "one")
    place = F.col("total")
    return r.select(
        "query_id", F.round(p, 6).alias("precision"), F.round(c, 6).alias("recall"), F.round(F.when(F.col("hits") > 0, 2 * p * c / (p + c)).otherwise(0.0), 6).alias("f1"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.when(F.col("hits") > 0, 1 / place).otherwise(0.0), 6).alias("query_place_rank"),
    )
