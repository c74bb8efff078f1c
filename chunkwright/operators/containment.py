"""Which texts contain which others, ignoring case: a substring join through postings of q-grams.

A text that contains a needle contains all of its q-grams, so a needle is looked up by one of them,
the one that the fewest texts hold. Only q-grams whose hash is divisible by SAMPLED are posted: they
are chosen by content, so a needle's are those of any text around it. Needles without such a one
(short ones, mostly) are looked up by the q-gram of smallest hash, in postings made for them alone.
Candidates are checked on the texts, so hashes decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.operators.ordered import stored

#: Characters of a q-gram; shorter needles are q-grams themselves.
GRAM = 8
#: Of all q-grams, every so manieth is posted.
SAMPLED = 8
#: Grams that a task gathers before it passes them on.
PASSED_ON = 1 << 18
#: Bits that stand for the q-grams which short needles look for.
BITS = 1 << 22

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(text: str, q: int) -> np.ndarray:
    """Distinct hashes of the q-grams of a text, ascending."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - q + 1
    if n <= 0:
        return codes[:0]
    found = np.full(n, np.uint64(q))
    for k in range(q):
        found = found * _BASE + codes[k : k + n]
    found = (found ^ (found >> np.uint64(31))) * _MIX
    return np.unique((found ^ (found >> np.uint64(29))) >> np.uint64(1))  # 63 bits: a long in Spark


def gram_batches(batches: Iterator[pa.RecordBatch], lengths: list[int] | None, bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """id, q, gram of batches of id and text: all sampled q-grams of GRAM characters if lengths is None, else all q-grams of these lengths whose bit is set.

    What is gathered is passed on at PASSED_ON grams, so a task holds these and one text's.
    """

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        ids, lengths_, found = zip(*rows)
        n = [len(x) for x in found]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(np.repeat(lengths_, n), pa.int32()), pa.array(np.concatenate(found).view(np.int64))], names=["id", "q", "gram"])

    rows, held = [], 0
    for batch in batches:
        for id_, text in zip(batch.column(0), batch.column(1)):
            id_, text = id_.as_py(), text.as_py()
            for q in [GRAM] if lengths is None else lengths:
                found = gram_hashes(text, q)
                if lengths is None:
                    found = found[found % np.uint64(SAMPLED) == 0]
                elif bits is not None:
                    found = found[bits[found % np.uint64(BITS)]]
                if len(found):
                    rows.append((id_, q, found))
                    held += len(found)
            if held >= PASSED_ON:
                yield frame(rows)
                rows, held = [], 0
    if rows:
        yield frame(rows)


def _grams(texts: DataFrame, lengths: list[int] | None, bits=None) -> DataFrame:
    """id, q, gram; bits: a broadcast of packed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gram_batches(batches, lengths, None if bits is None else np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool))

    return texts.select("id", "text").mapInArrow(run, "id long, q int, gram long")


def _bits_of(grams: DataFrame):
    """A broadcast of BITS packed bits, those of grams' hashes set: what no needle looks for mostly stays where it is found. BITS / 64 rows reach the driver at most."""
    words = grams.groupBy(F.expr(f"gram % {BITS} div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(gram % 64 AS INT)))").alias("set")).collect()
    packed = np.zeros(BITS // 64, np.int64)
    for r in words:
        packed[r["word"]] = r["set"]
    return grams.sparkSession.sparkContext.broadcast(packed.tobytes())


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle_id, text_id of every needle (id, text; not empty) and text (id, text) that contains it, ignoring case."""
    low = lambda df: df.select(F.col("id").cast("long").alias("id"), F.lower("text").alias("text")).where("text <> ''")
    needles, texts = stored(low(needles)), stored(low(texts))
    sampled = _grams(needles, None)
    wanted = sampled.select("gram").distinct()
    postings = stored(_grams(texts, None).join(wanted, "gram", "left_semi"))
    held = postings.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no text holds settles its needle: nothing contains it
    rarest = stored(sampled.join(held, "gram", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).select("id", "x.gram"))
    found = rarest.join(postings, "gram").select(rarest["id"].alias("needle_id"), postings["id"].alias("text_id"))
    others = needles.join(rarest.select("id"), "id", "left_anti").withColumn("q", F.least(F.length("text"), F.lit(GRAM)))
    lengths = sorted(r["q"] for r in others.select("q").distinct().collect())  # GRAM of them at most
    if lengths:
        short = _grams(others, lengths).join(others.select("id", "q"), ["id", "q"]).groupBy("id", "q").agg(F.min("gram").alias("gram"))
        short = stored(short)
        more = _grams(texts, lengths, _bits_of(short)).join(short.select("q", "gram").distinct(), ["q", "gram"], "left_semi")
        found = found.union(short.join(more.select(F.col("id").alias("text_id"), "q", "gram"), ["q", "gram"]).select(F.col("id").alias("needle_id"), "text_id"))
    pairs = stored(found)
    both = pairs.join(needles.select(F.col("id").alias("needle_id"), F.col("text").alias("needle")), "needle_id").join(texts.select(F.col("id").alias("text_id"), "text"), "text_id")
    return both.where(F.contains("text", "needle")).select("needle_id", "text_id")


def either_way(ones: DataFrame, others: DataFrame) -> DataFrame:
    """id, other_id of texts (id, text) of which one contains the other."""
    inside = containing(ones, others).select(F.col("needle_id").alias("id"), F.col("text_id").alias("other_id"))
    around = containing(others, ones).select(F.col("text_id").alias("id"), F.col("needle_id").alias("other_id"))
    return inside.union(around).distinct()
