"""Shards by global byte-size prefix sums.

Rows are ordered by a hash of their text, then doc_id, and dealt out in ranges of that order. Each
partition sums its sizes; the totals of the partitions, one row each, give every row its place among
all bytes, and targets cut that line into shards. Equal texts stand side by side.

A group of equal texts is never cut unless it alone is larger than a shard. Large groups (over
LARGE of a shard, so 1 / LARGE for each shard at most) are placed first, the largest where least has
been placed; one that exceeds a shard fills the emptiest shards one after the other. All other rows
then level the shards: the line of their bytes is cut where each shard reaches the common level, and
a group at a cut goes where its middle lies, so a shard is off the level by half of LARGE at most
(and by one row).

Defined results: null text is empty (8 bytes); very long texts are measured whole; null or repeated
doc_ids and repeated rows are rows like any other; ties in the order are equal in all columns but do
get slots of their own; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import local_prefix, materialize, text_of

ROW_BYTES = 8
#: From this share of a shard on, a group of equal texts is placed before all other rows.
LARGE = 0.02
ORDER = ["__hash", "doc_id", "size", "text_crc32"]


def placed_first(groups: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """For each large group (hash, bytes) its parts as (shard, bytes up to where), and the bytes of each shard so far."""
    target, loads, parts = -(-total // shards), [0] * shards, {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        parts[key], done = [], 0
        while done < size:
            at = min(range(shards), key=lambda s: (loads[s], s))
            room = size - done if size <= target else max(1, min(size - done, target - loads[at]))
            done += room
            loads[at] += room
            parts[key].append((at, done))
    return parts, loads


def level_cuts(loads: list[int], rest: int) -> list[int]:
    """Where the line of the remaining bytes is cut, so that shards with these loads reach one level."""
    shards = len(loads)
    ordered, under = sorted(loads), 0
    for k in range(1, shards + 1):
        under += ordered[k - 1]
        if k == shards or (rest + under) <= k * ordered[k]:
            break
    level, cuts, at = (rest + under) / k, [], 0.0
    for load in loads:
        at += max(0.0, level - load)
        cuts.append(round(at))
    return cuts


def _found(df: DataFrame, place: str, cuts: list[int], names: list[int] | None = None) -> DataFrame:
    """df with shard: the stretch between cuts that a place lies in (or the name of that stretch)."""
    bounds, of = np.array(cuts, np.int64), np.array(range(len(cuts)) if names is None else names, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.schema.get_field_index(place)).to_numpy(zero_copy_only=False)
            shard = of[np.minimum(np.searchsorted(bounds, at, side="right"), len(of) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, shard int")


def _starts(spark, placed: DataFrame, key: str | None = None) -> DataFrame:
    """__pid (and key), with the bytes and rows before it: from one row for each partition (and each value of key in it)."""
    keys = ["__pid"] if key is None else [key, "__pid"]
    rows = sorted(tuple(r) for r in placed.groupBy(*keys).agg(F.sum("size"), F.count("*")).collect())
    out, total, n, last = [], 0, 0, None
    for *at, size, count in rows:
        if key is not None and at[0] != last:
            total, n, last = 0, 0, at[0]
        out.append((*at, total, n))
        total, n = total + size, n + count
    kind = "" if key is None else f"{key} {placed.schema[key].dataType.simpleString()}, "
    return F.broadcast(spark.createDataFrame(out, f"{kind}__pid long, __bytes long, __rows long"))


def shard(docs: DataFrame, shards: int = 24, large: float = LARGE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text_of()) + ROW_BYTES).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"), F.xxhash64(text_of()).alias("__hash"))
    read = materialize(read)
    total = read.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = materialize(read.groupBy("__hash").agg(F.sum("size").alias("__all"), F.count("*").alias("__k")).where("__k > 1").drop("__k"))
    least = int(large * total / shards)
    big = [tuple(r) for r in groups.where(F.col("__all") > least).collect()]  # shards / large rows at most
    parts, loads = placed_first(big, shards, total)
    first = F.broadcast(spark.createDataFrame([(k, p[0][0] if len(p) == 1 else -1) for k, p in parts.items()], "__hash long, __first int"))
    marked = read.join(first, "__hash", "left")
    columns = ["doc_id", "size", "text_crc32", "__hash", "shard"]

    small = local_prefix(marked.where("__first IS NULL").drop("__first"), ORDER, "size")
    line = small.join(_starts(spark, small), "__pid").withColumn("__at", F.col("__before") + F.col("__bytes"))
    kept = groups.where(F.col("__all") <= least)
    begins = materialize(line.join(kept, "__hash").groupBy("__hash").agg(F.min("__at").alias("__from"), F.first("__all").alias("__all")))  # written first, so that a group's partition can be split in the join
    middle = line.join(begins, "__hash", "left").withColumn("__middle", F.expr("(2 * coalesce(__from, __at) + coalesce(__all, size)) div 2"))
    every = _found(middle.select("doc_id", "size", "text_crc32", "__hash", "__middle"), "__middle", level_cuts(loads, total - sum(s for _, s in big))).select(*columns)

    whole = marked.where("__first >= 0").withColumn("shard", F.col("__first")).select(*columns)
    every = every.unionByName(whole)
    over = {k: p for k, p in parts.items() if len(p) > 1}
    if over:  # fewer than shards
        inner = local_prefix(marked.where("__first = -1").drop("__first"), ORDER, "size", group="__hash")
        inner = inner.join(_starts(spark, inner, "__hash"), ["__hash", "__pid"]).withColumn("__at", F.col("__before") + F.col("__bytes"))
        for key, p in over.items():
            every = every.unionByName(_found(inner.where(F.col("__hash") == key).select("doc_id", "size", "text_crc32", "__hash", "__at"), "__at", [end for _, end in p], [s for s, _ in p]).select(*columns))

    ordered = local_prefix(materialize(every), ["shard", *ORDER], "size", group="shard")
    return ordered.join(_starts(spark, ordered, "shard"), ["shard", "__pid"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__row") + F.col("__rows")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
