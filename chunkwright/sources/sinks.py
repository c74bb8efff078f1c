"""Sinks: chunks and documents as JSON lines, markdown and hash-sharded results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(frame: DataFrame, path: str) -> None:
    """A JSON object for each row."""
    frame.select(F.to_json(F.struct(*frame.columns)).alias("value")).write.mode("overwrite").text(path)


def front_matter(frame: DataFrame, text: str, fields: list[str], *carried: str) -> DataFrame:
    """One markdown string for each row: the fields as YAML front matter, then the text; carried columns come first."""
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name).cast("string"), F.lit(""))) for name in fields]
    return frame.select(*carried, F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.coalesce(F.col(text), F.lit(""))).alias("value"))


def write_sharded(frame: DataFrame, key: str, path: str) -> None:
    """Rows under two levels of folders by their key's hash, so that single results are found by path."""
    h = F.sha2(F.col(key).cast("string"), 256)
    frame.withColumn("digest", h).withColumn("p1", F.substring(h, 1, 2)).withColumn("p2", F.substring(h, 3, 2)).repartition("p1").write.mode("overwrite").partitionBy("p1", "p2").parquet(path)


def load_sharded(spark, path: str, key: str) -> DataFrame:
    """The result of one key: the folders prune the scan to its own files."""
    import hashlib

    digest = hashlib.sha256(key.encode()).hexdigest()
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path).where((F.col("p1") == digest[:2]) & (F.col("p2") == digest[2:4]) & (F.col("digest") == digest))


def insert_new(store: DataFrame | None, rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text the store doesn't hold, once for each text."""
    keyed = rows.withColumn("digest", F.sha2(text, 256)).dropDuplicates(["digest"])
    return keyed if store is None else keyed.join(store.select("digest"), "digest", "left_anti")
