"""Helpers that the operators share: reliable intermediate tables, Arrow row batches, word hashes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a Python worker holds as Python objects at a time.
SLICE_ROWS = 256
#: Rows of an Arrow batch on its way to or from a worker: texts can be long, and both sides hold batches.
BATCH_ROWS = 1000


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a folder of our own, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="chunkwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete path when the driver's process ends."""

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)

    atexit.register(drop)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared checkpoint folder and read it back: lineage ends there.

    The table outlives lost executors and is dropped when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/chunkwright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables as materialize makes them, dropped at the end of a with block.

    What leaves the block must not read them any more: materialize it within the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{checkpoint_dir(spark)}/chunkwright/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches kept to BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Apply make()(columns) to slices of SLICE_ROWS rows of each partition.

    make runs once in a task; its function takes lists by column name and returns lists by column
    name, of any common length.
    """
    target = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(target)
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in out_schema], schema=out_schema)

    return small_batches(df).mapInArrow(run, target)


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


class WordIds(dict):
    """64-bit hashes of words, kept until `most` words are known."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: Odd multipliers of the mixing function below (fixed values).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


#: An odd base of window hashes (fixed value), and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1) modulo 2^64."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = _powers[base] = np.r_[np.uint64(1), np.cumprod(np.full(2 * n, base, np.uint64))]
    return found[:n]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles, in text order; fewer words than k make one shingle, no words none.

    Prefix sums of a polynomial modulo 2^64, whose windows are shifted to a common power.
    """
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    sums = np.r_[np.uint64(0), np.cumsum(words * powers(BASE, n))]
    return mix((sums[k:] - sums[:-k]) * powers(INVERSE, n - k + 1))


def occurrences(values: np.ndarray) -> np.ndarray:
    """For each value, how many equal ones stand before it."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(values) else np.zeros(0, bool)
    at = np.arange(len(values))
    first = np.maximum.accumulate(np.where(new, at, 0)) if len(values) else at
    out = np.empty(len(values), dtype=np.uint64)
    out[order] = (at - first).astype(np.uint64)
    return out


def local_prefix(df: DataFrame, order: list[str], weight: str | None, group: str | None = None) -> DataFrame:
    """df dealt out in ranges of `order`, with what stands before each row in its partition.

    Adds __pid (partitions are numbered in the order of their ranges), __row (rows before, from 0)
    and __before (sum of weight before; rows where weight is None). With group, which must lead the
    order, both counts start anew at each of its values. Ties are split by the later order columns,
    so one value never fills a partition on its own. The result is materialised.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("__pid", T.LongType()), T.StructField("__row", T.LongType()), T.StructField("__before", T.LongType())])
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, arrow, rows, total, last = TaskContext.get().partitionId(), to_arrow_schema(schema), 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            weights = np.ones(n, np.int64) if weight is None else batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            row, before = rows + np.arange(n), total + np.cumsum(weights) - weights
            if group is not None:
                keys = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
                new = np.r_[keys[0] != last, keys[1:] != keys[:-1]]
                at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
                row = np.where(at < 0, row, np.arange(n) - at)
                before = np.where(at < 0, before, before - before[np.maximum(at, 0)])
                last = keys[-1]
            rows, total = int(row[-1]) + 1, int(before[-1] + weights[-1])
            added = [pa.array(np.full(n, pid, np.int64)), pa.array(row), pa.array(before)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), *added], schema=arrow)

    return materialize(dealt.mapInArrow(run, schema))
