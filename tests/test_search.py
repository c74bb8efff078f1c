"""Exact search by scores made in slices."""

from __future__ import annotations

import numpy as np

from chunkwright.operators import vectors as V


def test_slices_of_scores_give_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (700, 6)).astype(float)  # many ties
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = frame.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    want = {(q, v, r) for q in range(0, 700, 10) for r, v in enumerate(sorted(range(700), key=lambda v: (-round(float(unit[q] @ unit[v]), 9), v))[:5], 1)}
    for scores in (70 * 7, 1, V.SCORES):  # seven rows at once, one, all
        monkeypatch.setattr(V, "SCORES", scores)
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in V.top_k(queries, frame, 5).collect()} == want
