"""Near duplicates by Order MinHash.

A text is the sequence of the five-word shingles of its lower-cased words (runs of word characters),
each labelled with how often it stood before. A sketch takes, for each of BANDS hash functions, the
DRAWN shingles of smallest hash and keeps them in text order, so that texts share a band only if the
same shingles come in the same order. Candidates are texts that share a band. They are verified by
banded alignment: matches of labelled shingles further than the band from the diagonal are left out,
the longest increasing chain of the others is the alignment, and its length over the number of
different positions is the similarity. Classes are the connected components of texts linked by a
similarity of `least`.

Components are what counts, so candidates are compared only while they are in different ones:

1. In each bucket the text that meets most others, summed over its buckets, leads, and is compared
   with all other members.
2. In buckets that still hold several components, each text outside the bucket's largest component
   is compared with all texts of others.

A parity vector goes before each alignment: a bit for each of CELLS cells of the shingles' hash,
flipped by each shingle. Two vectors differ in no more bits than the texts differ in shingles, so
pairs whose vectors differ in too many bits can't be similar, and no similar pair is lost by it. It
stands in the join's condition, so the second step emits only pairs that may be links. In a bucket
of texts that stay unlinked its evaluations grow with the square of their number; no pair is skipped.

Exact copies are one text from the start, so a group of copies costs one comparison.

Defined results: null text is empty, and all texts without words are one class; texts under five
words have one shingle; very long texts are read whole; null or repeated doc_ids and repeated rows
each give a row; the smallest doc_id (nulls last, then the smallest hash of the text) stands for its
class; of rows equal in doc_id and text deduplicate keeps one; leaders that meet equally many others
are chosen by hash; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chunkwright.llm.common import Scratch, WordIds, map_rows, materialize, mix, occurrences, shingle_hashes, text_of

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8, a band is shared with probability 0.8^5, one of 28 with 0.99998.
BANDS, DRAWN = 28, 5
#: Texts of few shingles have bands of their own with fewer drawn.
SHORT, SHORT_BANDS, SHORT_DRAWN = 8, 12, 2
#: Bits of the parity vector.
CELLS = 2048
#: Ids that are broadcast, so that the texts needn't be shuffled; beyond, they are joined by shuffle, with the same result.
MAX_BROADCAST = 500_000

_WORD = re.compile(r"\w+")

_SEEDS = mix(np.arange(1, 1 + BANDS + SHORT_BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def labelled_shingles(text: str, words: WordIds) -> np.ndarray:
    shingles = shingle_hashes(words.array(_WORD.findall(text.lower())), SHINGLE)
    return mix(shingles ^ mix(occurrences(shingles) + np.uint64(1)))


def _bands(x: np.ndarray, seeds: np.ndarray, drawn: int) -> np.ndarray:
    drawn = min(drawn, len(x))
    hashed = x[None, :] * seeds[:, None]  # x is a hash already, so an odd factor shuffles it anew
    taken = np.argpartition(hashed, drawn - 1, axis=1)[:, :drawn] if drawn < len(x) else np.tile(np.arange(len(x)), (len(seeds), 1))
    taken.sort(axis=1)  # back in text order
    out = seeds.copy()
    for j in range(drawn):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x[taken[:, j]])
    return out


def sketch(x: np.ndarray) -> np.ndarray:
    """The buckets of a text, in the order of the bands."""
    if not len(x):
        return np.zeros(1, np.uint64)
    found = _bands(x, _SEEDS[:BANDS], DRAWN)
    return np.r_[found, _bands(x, _SEEDS[BANDS:], SHORT_DRAWN)] if len(x) <= SHORT else found


def parity(x: np.ndarray) -> np.ndarray:
    """For each cell of the hash, whether an odd number of x falls into it, as CELLS / 64 integers."""
    odd = np.bincount((x % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _chained(j: np.ndarray) -> int:
    """Length of the longest increasing chain."""
    if (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned shingles over all positions of the banded alignment (0 under `least`)."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if min(n, m) < least * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < least * (n + m - len(i)):
        return 0.0
    j = j[np.argsort(i)]
    i = np.sort(i)
    band = int((n + m) * (1 - least) / (1 + least))  # insertions and deletions that `least` leaves room for
    chained = _chained(j[np.abs(i - j) <= band])
    found = chained / (n + m - chained)
    return found if found >= least else 0.0


def text_key(name: str = "text") -> Column:
    return F.unhex(F.md5(text_of(name)))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, number of shingles, parity vector, buckets."""

    def make() -> Callable:
        words = WordIds()

        def run(rows: dict[str, list]) -> dict[str, list]:
            lots = [labelled_shingles(t, words) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"], "key": rows["key"], "n": [len(x) for x in lots],
                "parity": [parity(x) for x in lots], "buckets": [sketch(x).view(np.int64) for x in lots],
            }

        return run

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), text_of().alias("text"))
    return map_rows(read, make, "doc_id long, key binary, n int, parity array<long>, buckets array<long>")


def distinct_texts(rows: DataFrame, *firsts: str) -> DataFrame:
    """One row for each key, with the smallest doc_id (null only if all are) and the number of rows."""
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in firsts])


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, text for the wanted texts; wanted: id, key, doc_id of one row with that text."""
    rows = docs.select(text_key().alias("key"), F.col("doc_id").cast("long").alias("row_id"), text_of().alias("text"))
    found = rows.join(wanted, (rows["key"] == wanted["key"]) & rows["row_id"].eqNullSafe(wanted["doc_id"])).select("id", "text")
    return found.groupBy("id").agg(F.first("text").alias("text"))


def accepted(scratch: Scratch, docs: DataFrame, pairs: DataFrame, cards: DataFrame, least: float) -> DataFrame:
    """The pairs a, b (ids) that are similar. cards: id, key, doc_id."""
    pairs = scratch.keep(pairs)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = cards.select("id", "key", "doc_id").join(ids, "id", "left_semi")
    held = scratch.keep(texts_of(docs, F.broadcast(wanted) if 2 * pairs.count() <= MAX_BROADCAST else wanted))
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def make() -> Callable:
        words = WordIds()
        last: list = [None, None]  # rows come sorted by b

        def run(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"a": rows["a"], "b": rows["b"], "similarity": []}
            for a, b, key in zip(rows["text_a"], rows["text_b"], rows["b"]):
                if key != last[0]:
                    last[:] = key, labelled_shingles(b, words)
                out["similarity"].append(similarity(labelled_shingles(a, words), last[1], least))
            return out

        return run

    return scratch.keep(map_rows(both, make, "a long, b long, similarity double").where(F.col("similarity") >= least).select("a", "b"))


def may_link(one: str, other: str, least: float) -> Column:
    """Whether lengths and parity vectors leave it open that two texts are similar."""
    n, m = F.col(f"{one}.n"), F.col(f"{other}.n")
    differ = sum((F.bit_count(F.col(f"{one}.parity")[i].bitwiseXOR(F.col(f"{other}.parity")[i])) for i in range(CELLS // 64)), F.lit(0))
    return (F.least(n, m) >= F.greatest(n, m) * least) & (differ <= (n + m) * ((1 - least) / (1 + least)) + 1e-6)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """id, label (the smallest id of its component) of linked texts, by label propagation with pointer jumping."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        moved = labels.join(near, "id").select("id", "label", F.least("label", "m").alias("next"))
        jumped = moved.join(labels.select(F.col("id").alias("next"), F.col("label").alias("far")), "next", "left")
        after = jumped.select("id", "label", F.least("next", F.coalesce("far", "next")).alias("next"))
        seen = Observation()
        labels = scratch.keep(after.observe(seen, F.count_if(F.col("label") != F.col("next")).alias("moved")).select("id", F.col("next").alias("label")))
        if not seen.get["moved"]:
            return labels


def met_by_leaders(scratch: Scratch, members: DataFrame, cards: DataFrame, least: float) -> DataFrame:
    """a, b: each bucket's leader and the members that it may be linked with. members: bucket, id, weight."""
    lead = F.max(F.struct("weight", F.xxhash64("id").alias("draw"), F.col("id").alias("id"))).alias("lead")
    leaders = scratch.keep(members.groupBy("bucket").agg(lead).select("bucket", F.col("lead.id").alias("leader")))  # written first, so that a frequent bucket's partition can be split in the join
    pairs = members.join(leaders, "bucket").where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    card = lambda side: cards.select(F.col("id").alias(side), F.struct("n", "parity").alias(f"card_{side}"))
    return pairs.join(card("a"), "a").join(card("b"), "b").where(may_link("card_a", "card_b", least)).select("a", "b")


def met_by_all(scratch: Scratch, members: DataFrame, labels: DataFrame, cards: DataFrame, least: float) -> DataFrame:
    """a, b in a bucket and in different components, not both in the bucket's largest one, that may be linked."""
    members = members.where("size > 2").join(labels, "id", "left")  # in a bucket of two, both have met
    members = scratch.keep(members.select("bucket", "id", F.coalesce("label", "id").alias("comp")))
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    unsettled = scratch.keep(sizes.groupBy("bucket").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("most")).where("comps > 1").select("bucket", F.col("most.comp").alias("largest")))
    members = members.join(unsettled, "bucket").join(cards.select("id", "n", "parity", "buckets"), "id")
    members = scratch.keep(members.select("bucket", "id", "comp", "n", "parity", "buckets", (F.col("comp") == F.col("largest")).alias("inner")))
    one, other = members.where("NOT inner").alias("one"), members.alias("other")
    once = F.expr("(other.inner OR one.id < other.id) AND one.comp <> other.comp")
    first = F.expr("array_min(array_intersect(one.buckets, other.buckets)) = one.bucket")  # of all buckets that they share
    met = one.join(other, (F.col("one.bucket") == F.col("other.bucket")) & once & may_link("one", "other", least) & first)
    return met.select(F.least("one.id", "other.id").alias("a"), F.greatest("one.id", "other.id").alias("b"))


def linked(scratch: Scratch, docs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """id, label of all texts that are similar to another one. texts: id, key, doc_id, n, parity, buckets."""
    every = texts.select("id", F.explode("buckets").alias("bucket"))
    shared = scratch.keep(every.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    members = scratch.keep(every.join(shared, "bucket"))
    members = scratch.keep(members.join(members.groupBy("id").agg(F.sum("size").alias("weight")), "id"))
    cards = scratch.keep(texts.join(members.select("id").distinct(), "id", "left_semi"))
    links = accepted(scratch, docs, met_by_leaders(scratch, members, cards, least), cards, least)
    labels = components(scratch, links)
    more = accepted(scratch, docs, met_by_all(scratch, members, labels, cards, least), cards, least)
    return labels if more.isEmpty() else components(scratch, links.union(more))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """A row for each row of docs: doc_id, class_id, class_rows, key, rep_key."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(sketches(docs))
        texts = scratch.keep(distinct_texts(rows, "n", "parity", "buckets").withColumn("id", F.monotonically_increasing_id()))
        labels = linked(scratch, docs, texts, least)
        own = texts.select("id", "key", "doc_id", "copies").join(labels, "id", "left")
        own = scratch.keep(own.select("key", "doc_id", "copies", F.coalesce("label", "id").alias("label")))
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
        groups = scratch.keep(own.groupBy("label").agg(best.alias("rep"), F.sum("copies").alias("class_rows")))
        named = scratch.keep(own.join(groups, "label").select("key", F.col("rep.doc_id").alias("class_id"), "class_rows", F.col("rep.key").alias("rep_key")))
        return materialize(rows.select("doc_id", "key").join(named, "key").select("doc_id", "class_id", "class_rows", "key", "rep_key"))


def deduplicate(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their classes, one for each, with all their columns."""
    stay = classes(docs, least).where("key = rep_key AND doc_id <=> class_id").groupBy("key", "doc_id").agg(F.count("*").alias("rows"))
    stay = materialize(stay)
    keyed = docs.select(F.struct("*").alias("row"), text_key().alias("row_key"), F.col("doc_id").cast("long").alias("row_id"))
    found = keyed.join(stay, (keyed["row_key"] == stay["key"]) & keyed["row_id"].eqNullSafe(stay["doc_id"])).select("row", "key", "doc_id", "rows")
    once = found.where("rows = 1").select("row.*")
    if stay.where("rows > 1").isEmpty():
        return once
    return once.unionByName(found.where("rows > 1").dropDuplicates(["key", "doc_id"]).select("row.*"))
