"""Neighbours and running sums of rows in order, without a task for each group.

Rows are dealt out in ranges of their order, so a group may span tasks; only each task's first and last
rows (or sums) meet, two for each partition.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, one of our own, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="chunkwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop_later(spark: SparkSession, path: str) -> None:
    """Delete path when the driver's process ends."""

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)

    atexit.register(drop)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: it outlives lost executors and goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chunkwright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *order: str) -> DataFrame:
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)


def with_next(df: DataFrame, group: str, order: str, carried: str) -> DataFrame:
    """group, order, carried, and next: `carried` of the group's next row (null for the last one)."""
    fields = [df.schema[c] for c in (group, order, carried)]
    schema = T.StructType([*fields, T.StructField("next", df.schema[carried].dataType), T.StructField("pid", T.IntegerType()), T.StructField("edge", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, target, held, first = TaskContext.get().partitionId(), to_arrow_schema(schema), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            held = table.slice(table.num_rows - 1)
            if first:  # the partition's first row is what the one before waits for
                yield from _out(table.slice(0, 1), None, pid, 1, target)
                first = False
            if table.num_rows > 1:
                yield from _out(table.slice(0, table.num_rows - 1), table.slice(1), pid, 0, target)
        if held is not None:
            yield from _out(held, None, pid, 2, target)

    def _out(rows: pa.Table, after: pa.Table | None, pid: int, edge: int, target: pa.Schema) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        if after is None:
            nxt = pa.nulls(n, target.field("next").type)
        else:
            import pyarrow.compute as pc

            same = pc.equal(rows.column(0), after.column(0)).combine_chunks()
            at = pc.if_else(same, pa.array(np.arange(n)), None)
            nxt = after.column(2).combine_chunks().take(at)
        columns = [*(rows.column(i).combine_chunks().cast(target.field(i).type) for i in range(3)), nxt.cast(target.field("next").type), pa.array(np.full(n, pid, np.int32)), pa.array(np.full(n, edge, np.int32))]
        yield from pa.Table.from_arrays(columns, schema=target).to_batches()

    placed = stored(dealt(df.select(group, order, carried), group, order).mapInArrow(run, schema))
    # two rows for each partition: what the last one waits for is the next partition's first
    edges = placed.where("edge > 0").withColumn("ahead", F.lead(F.struct(group, carried)).over(Window.orderBy("pid", "edge"))).where("edge = 2")
    last = edges.select(group, order, carried, F.when(F.col(f"ahead.{group}") == F.col(group), F.col(f"ahead.{carried}")).alias("next"))
    return placed.where("edge = 0").select(group, order, carried, "next").unionByName(last)


def running_sum(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """df with total: the sum of `value` over the group's rows up to and with this one."""
    schema = T.StructType([*df.schema.fields, T.StructField("total", T.LongType()), T.StructField("pid", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, target, last, total = TaskContext.get().partitionId(), to_arrow_schema(schema), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.r_[last is None or keys[0] != last, keys[1:] != keys[:-1]].astype(bool)
            summed = np.cumsum(values)
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            sums = np.where(at < 0, total + summed, summed - (summed - values)[np.maximum(at, 0)])
            last, total = keys[-1], int(sums[-1])
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, target)), pa.array(sums), pa.array(np.full(n, pid, np.int32))], schema=target)

    placed = stored(dealt(df, group, order).mapInArrow(run, schema))
    # a group's rows in one partition add to those in the ones after it; groups within one partition add to none
    sums = placed.groupBy("pid", group).agg(F.sum(value).alias("own"))
    spans = Window.partitionBy(group).orderBy("pid")
    before = sums.withColumn("before", F.sum("own").over(spans.rowsBetween(Window.unboundedPreceding, -1))).where("before IS NOT NULL").select("pid", F.col(group).alias("g"), "before")
    joined = placed.join(F.broadcast(before), (placed["pid"] == before["pid"]) & (placed[group] == before["g"]), "left")  # a row for each partition at most
    return joined.select(*[placed[c] for c in df.columns], (F.col("total") + F.coalesce("before", F.lit(0))).alias("total"))
