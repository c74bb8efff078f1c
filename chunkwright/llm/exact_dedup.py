"""Exact duplicates by distributed MSD radix partitioning.

Texts are equal when identical after lower-casing A to Z. Documents are split by successive blocks
of their UTF-8 bytes, from the first on. In each round the documents of a group are counted by their
next block and by whether their text ends with it; equal counts are summed before the shuffle, so a
group of copies of any size arrives as one row from each task. A document alone in its group is
done, and so is a group that has ended: its texts are equal byte by byte, without any digest. Only
the others go on, each with the bytes that are left and the number of its group. Blocks grow by
GROWTH from round to round, so a group of long copies needs few rounds (four up to 149,000 bytes).

Each round's rows are written before the next, so lost executors cost a part of a round. Documents
meet the counts of their groups in a join whose hot keys can be split, as nothing above it needs a
key's rows together.

Defined results: null text is empty, and all empty texts are one group that ends at once; texts are
read whole; the row with the largest doc_id stays; null doc_ids count as smaller than all others,
and a group that has no other keeps one row, with null keep_id; of repeated rows, or others equal in
doc_id and text, exactly one is kept; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chunkwright.llm.common import Scratch, materialize, text_of

#: Bytes of the first block, and how much longer each next one is.
BLOCK, GROWTH = 256, 8


def normalised(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _round(scratch: Scratch, left: DataFrame, width: int, number: int) -> tuple[DataFrame, bool]:
    """One split. left: doc_id, sha, group, rest. Returns rows with size, keep_id, class and rest (null once done), and whether any go on."""
    keyed = left.select("doc_id", "sha", "group", F.substring("rest", 1, width).alias("block"), (F.octet_length("rest") <= width).alias("ended"), "rest")
    key = ["group", "block", "ended"]
    shared = keyed.groupBy(*key).agg(F.count("*").alias("size"), F.max("doc_id").alias("keep_id")).where("size > 1")
    shared = scratch.keep(shared.withColumn("next", F.monotonically_increasing_id()))
    met = keyed.join(shared, key, "left")
    on = F.col("next").isNotNull() & ~F.col("ended")
    seen = Observation()
    rows = met.select(
        "doc_id", "sha", F.coalesce("size", F.lit(1)).alias("size"), F.when(F.col("next").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.lit(number).alias("round"), "next", F.when(on, F.expr(f"substring(rest, {width + 1})")).alias("rest"), F.monotonically_increasing_id().alias("row"),
    )
    rows = scratch.keep(rows.observe(seen, F.count("rest").alias("on")))
    return rows, seen.get["on"] > 0


def groups(docs: DataFrame, block: int = BLOCK, growth: int = GROWTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) of every row."""
    with Scratch(docs.sparkSession) as scratch:
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_of()).alias("text"))
        left = text.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.lit(0).cast("long").alias("group"), F.col("text").cast("binary").alias("rest"))
        rounds, width, on = [], block, True
        while on:
            rows, on = _round(scratch, left, width, len(rounds))
            rounds.append(rows.where("rest IS NULL").drop("rest"))
            left = rows.where("rest IS NOT NULL").select("doc_id", "sha", F.col("next").alias("group"), "rest")
            width *= growth
        done = reduce(DataFrame.unionByName, rounds)
        first = done.where("size > 1 AND doc_id <=> keep_id").groupBy("round", "next").agg(F.count("*").alias("equal"), F.max("row").alias("chosen")).where("equal > 1").drop("equal")
        marked = done.join(scratch.keep(first), ["round", "next"], "left")
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chosen").isNull() | (F.col("row") == F.col("chosen")))
        return materialize(marked.select("doc_id", "keep_id", F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")))


ORACLE = f"""WITH read AS (SELECT doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(text) AS text_sha256 FROM read WINDOW t AS (PARTITION BY text)"""
