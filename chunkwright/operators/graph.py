"""Chunk graphs: nodes, edges by kind, caps, neighbours and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.operators.ordered import stored


def by_place():
    return Window.partitionBy("doc_id").orderBy("chunk_index")



def nodes(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_index, prev_index, next_index."""
    return chunks.select("doc_id", "chunk_index", F.lag("chunk_index").over(by_place()).alias("prev_index"), F.lead("chunk_index").over(by_place()).alias("next_index"))


def _edge(src, dst, kind: str, weight: float, label) -> list:
    return [F.col("doc_id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), label.alias("label")]


def sequential(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("next", F.lead("chunk_index").over(by_place())).where("next IS NOT NULL").select(*_edge(F.col("chunk_index"), F.col("next"), "Sequential", 1.0, F.lit("follows")))


def hierarchical(paths: DataFrame) -> DataFrame:
    """From the nearest earlier chunk whose heading path is a proper prefix (ignoring case). paths: doc_id, chunk_index, path (array).

    Each proper prefix of a path is looked up by value, so chunks are joined on document and prefix
    instead of to all earlier ones.
    """
    low = paths.where("size(path) > 0").select("doc_id", "chunk_index", F.transform("path", F.lower).alias("path"))
    own = low.select("doc_id", F.col("chunk_index").alias("src"), F.array_join("path", "\x01").alias("key"))
    prefixes = low.select("doc_id", "chunk_index", F.explode(F.expr("transform(sequence(0, size(path) - 1), k -> array_join(slice(path, 1, k), '\x01'))")).alias("key"))
    roots = paths.where("size(path) = 0").select("doc_id", F.col("chunk_index").alias("src"), F.lit("").alias("key"))
    found = prefixes.join(own.union(roots), ["doc_id", "key"]).where("src < chunk_index").groupBy("doc_id", "chunk_index").agg(F.max("src").alias("src"))
    return found.select(*_edge(F.col("src"), F.col("chunk_index"), "Hierarchical", 0.8, F.lit("contains")))


def shared_entities(entities: DataFrame, distance: int = 10) -> DataFrame:
    """Between chunks of a document that share an entity within `distance`. entities: doc_id, chunk_index, entity.

    Chunks are joined by entity and place bucket, the next bucket included: a frequent entity gives
    pairs in proportion to its places, not to their square.
    """
    e = entities.select("doc_id", "chunk_index", F.lower("entity").alias("entity")).distinct()
    a = e.select("doc_id", "entity", F.col("chunk_index").alias("src"), F.explode(F.expr(f"array(chunk_index div {distance}, chunk_index div {distance} + 1)")).alias("bucket"))
    b = e.select("doc_id", "entity", F.col("chunk_index").alias("dst"), F.expr(f"chunk_index div {distance}").alias("bucket"))
    pairs = a.join(b, ["doc_id", "entity", "bucket"]).where(f"src < dst AND dst - src <= {distance}")
    return pairs.select(*_edge(F.col("src"), F.col("dst"), "SharedEntity", 0.6, F.concat(F.lit("shares: "), "entity")))


def capped(edges: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` edges of each source: sequential, hierarchical, then shared ones by target and label."""
    order = F.when(F.col("kind") == "Sequential", 0).when(F.col("kind") == "Hierarchical", 1).otherwise(2)
    w = Window.partitionBy("doc_id", "src").orderBy(order, "dst", "label")
    return edges.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def neighbours(edges: DataFrame) -> DataFrame:
    both = edges.select("doc_id", F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("doc_id", F.col("dst").alias("a"), F.col("src").alias("b")))
    return both.where("a <> b").distinct()


def distances(edges: DataFrame, start: int = 0) -> DataFrame:
    """doc_id, node, steps, path: undirected steps from chunk `start` to every chunk that it reaches, and the nodes between them.

    A breadth-first search over all documents at once, a join for each step; of equally short paths the
    one through the smallest node before is taken. Each round's frontier is written, so plans stay short.
    """
    near = stored(neighbours(edges))
    reached = stored(near.select("doc_id").distinct().select("doc_id", F.lit(start).cast("long").alias("node"), F.lit(0).alias("steps"), F.lit(str(start)).alias("path")))
    frontier, rounds = reached, [reached]
    while not frontier.isEmpty():
        ahead = frontier.join(near, (near["doc_id"] == frontier["doc_id"]) & (near["a"] == frontier["node"])).select(
            frontier["doc_id"], F.col("b").alias("node"), (F.col("steps") + 1).alias("steps"), F.struct(F.col("node").alias("before"), F.concat("path", F.lit(","), F.col("b").cast("string")).alias("path")).alias("way")
        )
        best = ahead.groupBy("doc_id", "node", "steps").agg(F.min("way").alias("way")).select("doc_id", "node", "steps", F.col("way.path").alias("path"))
        seen = rounds[0].select("doc_id", "node")
        for r in rounds[1:]:
            seen = seen.union(r.select("doc_id", "node"))
        frontier = stored(best.join(seen, ["doc_id", "node"], "left_anti"))
        rounds.append(frontier)
    for r in rounds[1:]:
        reached = reached.union(r)
    return reached


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, from, to, path (array of nodes): shortest undirected paths between stated pairs; null where there is none, [from] where both are one.

    A search from both ends over all pairs at once: the ends take turns to go a step, and a pair leaves
    both as soon as they meet, or when one can go no further. From the meeting nodes the path goes on
    through the levels that the other end has been through. Of equally short paths it is the one whose
    last node but one is smallest, then the one before, and so on. Each level is written.
    """
    near = stored(neighbours(edges))
    asked = pairs.select("doc_id", "from", "to").distinct()
    key = ["doc_id", "from", "to"]
    same = asked.where(F.col("from") == F.col("to")).select(*key, F.array("from").alias("path"))
    apart = stored(asked.where(F.col("from") != F.col("to")))

    def step(level: DataFrame) -> DataFrame:
        """The nodes next to a level, each by its smallest predecessor."""
        met = level.join(near.select("doc_id", F.col("a").alias("node"), F.col("b").alias("next")), ["doc_id", "node"])
        best = met.groupBy(*key, "next").agg(F.min_by("path", "node").alias("path"))
        return best.select(*key, F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))

    def onwards(levels: list[DataFrame], open_pairs: DataFrame) -> DataFrame:
        """The next level: what isn't in the last two, of pairs that are still open."""
        ahead = step(levels[-1].join(open_pairs, key, "left_semi"))
        for level in levels[-2:]:
            ahead = ahead.join(level.select(*key, "node"), [*key, "node"], "left_anti")
        return stored(ahead)

    starts = [stored(apart.select(*key, F.col("from").alias("node"), F.array("from").alias("path")))]
    ends = [stored(apart.select(*key, F.col("to").alias("node"), F.array("to").alias("path")))]
    open_pairs, found = apart, []
    while not open_pairs.isEmpty():
        side, other = (starts, ends) if len(starts) <= len(ends) else (ends, starts)
        side.append(onwards(side, open_pairs))
        meeting = starts[-1].join(ends[-1].select(*key, "node"), [*key, "node"], "left_semi")
        for level in reversed(ends[:-1]):
            meeting = step(meeting).join(level.select(*key, "node"), [*key, "node"], "left_semi")
        met = stored(meeting.select(*key, "path"))
        found.append(met)
        moved = side[-1].select(*key).distinct()
        open_pairs = stored(open_pairs.join(moved, key, "left_semi").join(met.select(*key), key, "left_anti"))
    every = same
    for met in found:
        every = every.unionByName(met)
    return asked.join(every, key, "left")


def multi_hop(chunks: DataFrame, edges: DataFrame, ask, least: float = 0.1, most: int = 3) -> DataFrame:
    """doc_id, src, dst, question, answer, score, rank: questions on pairs of chunks that an edge relates. chunks: doc_id, chunk_index, text.

    ask takes the two texts' columns and gives a struct of question, answer and score. Of a document
    the best `most` with a score of `least` or more stay, and of equal questions over all documents
    the best one.
    """
    texts = chunks.select("doc_id", "chunk_index", "text")
    pairs = edges.where("src < dst").select("doc_id", "src", "dst").union(edges.where("src > dst").select("doc_id", "dst", "src")).distinct()
    both = pairs.join(texts.select("doc_id", F.col("chunk_index").alias("src"), F.col("text").alias("one")), ["doc_id", "src"]).join(texts.select("doc_id", F.col("chunk_index").alias("dst"), F.col("text").alias("other")), ["doc_id", "dst"])
    asked = stored(both.select("doc_id", "src", "dst", ask(F.col("one"), F.col("other")).alias("x")).select("doc_id", "src", "dst", "x.*").where((F.col("score") >= least) & F.col("question").isNotNull()))
    best = asked.groupBy("question").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("d"), (-F.col("src")).alias("s"), (-F.col("dst")).alias("t"), "answer")).alias("x"))
    once = best.select((-F.col("x.d")).alias("doc_id"), (-F.col("x.s")).alias("src"), (-F.col("x.t")).alias("dst"), "question", "x.answer", "x.score")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "src", "dst", "question"))
    return once.withColumn("rank", place).where(F.col("rank") <= most)
