"""URL filters by link-graph propagation.

Rules judge the urls that they fit. For the others, hosts are scored on the graph of links between
hosts by two personalised PageRanks: trust starts from hosts in proportion to their allowed pages and
follows links, distrust starts from blocked ones and goes against links. A walk starts anew with
probability 1 - DAMPING, and always from hosts that lead nowhere, so ranks keep the seeds' sum. Rounds
go on until a round moves less than CLOSE of that sum. Scores are ranks in units of what a host
holds that rules judge wholly (the seeds' mean of rank by seed), and a host whose distrust exceeds
its trust by `threshold` is blocked.

Defined results: null urls and urls without `://` have an empty host and path, fit no rule and are
allowed; null html has no links; very long pages are read whole; repeated rows count as pages of their
own; without links between hosts the scores are the seeds, i.e. a host's other pages are blocked where
at least half of its pages more are blocked than allowed by rules; distrust that exceeds trust by
just the threshold blocks; an empty table gives no rows; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import materialize

#: The rules, host and path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.85
ROUNDS_AT_ONCE = 5
#: A round that moves less than this share of all rank is the last: ranks are off by less than CLOSE * DAMPING / (1 - DAMPING) of it.
CLOSE = 1e-5
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with the longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):  # the longest last, so outermost
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts with their numbers; counted on the map side before the shuffle."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?((?:https?:)?//[^\s"'>]+)"""), F.lit(1))
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(hrefs).alias("href"))
    to = host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href")))
    return found.select("src", to.alias("dst")).where("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(hosts: DataFrame, links: DataFrame, damping: float = DAMPING, close: float = CLOSE) -> DataFrame:
    """host, trust, distrust. hosts: host, trust_seed, distrust_seed. Both walks run in one frame, keyed by kind."""
    one_way = links.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n")
    edges = one_way.unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))
    edges = materialize(edges)
    out = materialize(edges.groupBy("kind", "a").agg(F.sum("n").alias("all")))  # written first, so that a hub's partition can be split in the join
    weights = materialize(edges.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("w")))
    seeds = hosts.selectExpr("host", "stack(2, 'trust', trust_seed, 'distrust', distrust_seed) AS (kind, seed)")
    reached = weights.selectExpr("kind", "b AS host").distinct().select("host", "kind", F.lit(0.0).alias("seed"))
    seeds = seeds.unionByName(reached).groupBy("host", "kind").agg(F.max("seed").alias("seed"))
    ends = out.selectExpr("kind", "a AS host", "true AS goes")
    ranks = seeds.join(ends, ["kind", "host"], "left").select("kind", "host", "seed", F.coalesce("goes", F.lit(False)).alias("goes"), F.col("seed").alias("rank"))
    ranks = materialize(ranks)
    moving = not weights.isEmpty()  # without links the ranks are the seeds
    while moving:
        for at in range(ROUNDS_AT_ONCE):
            # a row for each kind
            ended = ranks.groupBy("kind").agg(F.sum(F.when(F.col("goes"), 0.0).otherwise(F.col("rank"))).alias("ended"), F.sum("seed").alias("sown")).where("sown > 0")
            sent = ranks.where("rank > 0").selectExpr("kind", "host AS a", "rank").join(weights, ["kind", "a"]).groupBy("kind", F.col("b").alias("host")).agg(F.sum(F.expr("rank * w")).alias("got"))
            again = F.col("seed") * ((1 - damping) + damping * F.coalesce(F.try_divide("ended", "sown"), F.lit(0.0)))
            ranks = ranks.join(F.broadcast(ended), "kind", "left").join(sent, ["kind", "host"], "left").select(
                "kind", "host", "seed", "goes", (again + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("was")
            )
            if at < ROUNDS_AT_ONCE - 1:
                ranks = ranks.drop("was")
        ranks = materialize(ranks)
        moved = ranks.groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("moved"), F.sum("seed").alias("sown"))
        moving = not moved.where(F.col("moved") > close * F.col("sown")).isEmpty()
        ranks = ranks.drop("was")
    unit = ranks.groupBy("kind").agg(F.try_divide(F.sum(F.expr("rank * seed")), F.sum(F.expr("seed * seed"))).alias("unit"))  # a row for each kind
    scaled = ranks.join(F.broadcast(unit), "kind").withColumn("score", F.coalesce(F.try_divide("rank", "unit"), F.lit(0.0)))
    one = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return scaled.groupBy("host").agg(one("trust"), one("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    read = with_rule(read, rules)
    share = lambda said: (F.count_if(F.col("ruled") == said) / F.count("*")).alias
    hosts = materialize(read.where("host <> ''").groupBy("host").agg(share("allow")("trust_seed"), share("block")("distrust_seed")))
    scores = materialize(propagate(hosts, host_links(read)))  # written first, so that a frequent host's partition can be split in the join
    judged = read.drop("html").join(scores, "host", "left")
    own = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) >= threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
