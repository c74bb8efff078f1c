"""Queries that run as streams: the given tables arrive in several micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from chunkwright.operators.ordered import drop_later, shared_dir
from chunkwright.plans.corpora import table
from chunkwright.plans.registry import query
from chunkwright.streaming import pieces as P

SIZE, OVERLAP, BATCHES = 256, 64, 4


@query(
    "c14_streamed_chunks",
    f"""WITH t AS (SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), '' ORDER BY turn, text) AS text FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    w AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - {OVERLAP}) / {SIZE - OVERLAP}.0) AS BIGINT)))) AS chunk_index FROM t)
    SELECT doc_id, chunk_index, chunk_index * {SIZE - OVERLAP} AS start_char, substr(text, CAST(chunk_index * {SIZE - OVERLAP} + 1 AS BIGINT), {SIZE}) AS content, true AS complete FROM w""",
)
def streamed_chunks(spark, sf_dir):
    """A conversation's turns are the pieces of a document; they arrive dealt out over files, one file a micro-batch."""
    order = Window.partitionBy("conv_id")
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    pieces = turns.select(F.col("conv_id").alias("doc_id"), (F.row_number().over(order.orderBy("turn", "text")) - 1).alias("piece"), F.count("*").over(order).cast("int").alias("pieces"), "text")
    folder = f"{shared_dir(spark)}/chunkwright/stream-{uuid.uuid4().hex}"
    drop_later(spark, folder)
    pieces.repartition(BATCHES, F.xxhash64("doc_id", "piece")).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(P.PIECES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    running = P.chunked(arriving, SIZE, OVERLAP).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(P.CHUNKS).parquet(f"{folder}/out").drop("end_char")
