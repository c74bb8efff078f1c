"""Similarity of vectors, exact search, and boundaries between neighbouring segments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.operators.ordered import stored, with_next

#: Queries whose vectors are sent to every task at once; more go through in blocks.
QUERY_BLOCK = 2_000
#: Scores that a task makes at once.
SCORES = 1 << 20


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, vec_id, score, rank: a stated set of queries against all vectors, exactly.

    Each task scores its vectors against one block of queries, SCORES at once, and keeps its best k for
    each query, so at most k rows for a query and task are shuffled. Of several blocks, each is sent, met and written
    before the next one is read: the driver holds one at a time.
    """
    import pyarrow as pa

    spark = vectors.sparkSession

    def met(part: DataFrame):
        rows = part.select("query_id", "embedding").collect()  # one block
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)))

        def best(batches):
            ids, q = shared.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            held_ids, held = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for batch in batches if len(ids) else ():
                step = max(1, SCORES // len(ids))
                for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                    v = np.array(part.column(1).to_pylist(), dtype=np.float64)
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                    scores = np.concatenate([held, q @ v.T], axis=1)
                    vec = np.concatenate([held_ids, np.tile(part.column(0).to_numpy(zero_copy_only=False), (len(ids), 1))], axis=1)
                    order = _best_places(-np.round(scores, 9), vec, k)
                    held, held_ids = np.take_along_axis(scores, order, 1), np.take_along_axis(vec, order, 1)
            if held.shape[1]:
                m = held.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(held_ids.ravel()), pa.array(held.ravel())], names=["query_id", "vec_id", "score"])

        return shared, vectors.select("vec_id", "embedding").mapInArrow(best, "query_id long, vec_id long, score double")

    blocks = -(-queries.count() // QUERY_BLOCK)
    if blocks <= 1:
        found = met(queries)[1]
    else:
        found = None
        for i in range(blocks):
            shared, frame = met(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i))
            frame = stored(frame)
            shared.destroy()
            found = frame if found is None else found.unionAll(frame)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _best_places(cost: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """For each row, the columns of the k least costs, ties by vec. All rows have as many columns, k or fewer are kept whole."""
    k = min(k, cost.shape[1])
    limit = np.partition(cost, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(cost), k), np.int64)
    for i in range(len(cost)):
        near = np.flatnonzero(cost[i] <= limit[i])
        out[i] = near[np.lexsort((vec[i, near], cost[i, near]))[:k]]
    return out


def neighbour_similarity(segments: DataFrame) -> DataFrame:
    """doc_id, i, similarity of each segment to the next; segments: doc_id, i, embedding."""
    near = with_next(segments, "doc_id", "i", "embedding").where("next IS NOT NULL")
    return near.select("doc_id", "i", cosine(F.col("embedding"), F.col("next")).alias("similarity"))


def merge_nearby(boundaries: DataFrame, distance: int = 2) -> DataFrame:
    """doc_id, i, confidence: of boundaries within `distance` of the last kept one, the stronger stays.

    The anchor moves with what is kept, so it is a fold in a document's order; rows stream through it,
    and one boundary at a time is held.
    """
    import pyarrow as pa

    def run(batches):
        last = None
        for batch in batches:
            out: list[tuple] = []
            for doc_id, i, confidence in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if last is not None and last[0] == doc_id and i - last[1] <= distance:
                    if confidence > last[2]:
                        last = doc_id, i, confidence
                    continue
                if last is not None:
                    out.append(last)
                last = doc_id, i, confidence
            if out:
                yield frame(out)
        if last is not None:
            yield frame([last])

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        doc_id, i, confidence = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(i, pa.int64()), pa.array(confidence, pa.float64())], names=["doc_id", "i", "confidence"])

    rows = boundaries.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("i").cast("long").alias("i"), "confidence")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "i").mapInArrow(run, "doc_id long, i long, confidence double")
