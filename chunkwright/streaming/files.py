"""Streaming ingestion: files as they arrive are refined, chunked and appended; progress comes from Spark's own listener."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkwright.functions.rewrite import RULES, column
from chunkwright.operators.chunking import fixed_windows

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def chunk_stream(spark: SparkSession, path: str, size: int = 1024, overlap: int = 128, schema: str = DOCUMENTS) -> DataFrame:
    """An unbounded frame of chunks: the same columns, from the same rules, as in a batch."""
    return refined_chunks(spark.readStream.schema(schema).parquet(path), size, overlap)


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (hash of the path), path, text of text files as they arrive, a row for each file."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def refined_chunks(docs: DataFrame, size: int = 1024, overlap: int = 128) -> DataFrame:
    """Chunks of refined documents, batch or stream."""
    text = column(column(F.col("text"), RULES["clean_noise"]), RULES["normalize_whitespace"])
    return fixed_windows(docs.select("doc_id", text.alias("text")).where("length(text) > 0"), size, overlap)


def write_chunks(chunks: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append chunks as Parquet, once for each input file; a restart goes on from the checkpoint."""
    writer = chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def each_batch(chunks: DataFrame, handle, checkpoint: str) -> StreamingQuery:
    """Call handle(frame, batch number) for each micro-batch, at least once."""
    return chunks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
