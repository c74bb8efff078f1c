"""Grid joins of boxes against comparing all."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from chunkwright.operators import boxes as B

SCHEMA = "page long, id long, left double, top double, right double, bottom double"


def made(rng, n, far):
    out = []
    for i in range(n):
        x, y = rng.choice([rng.uniform(-far, far), 10 * rng.randint(-9, 9)]), rng.uniform(-far, far)
        w, h = rng.choice([0.0, 10.0, rng.uniform(0, 300)]), rng.choice([0.0, rng.uniform(0, 300)])
        out.append((rng.randint(0, 3), i, float(x), y, x + w, y + h))
    return out


def gap(a, b):
    return math.hypot(max(0, b[2] - a[4], a[2] - b[4]), max(0, b[3] - a[5], a[3] - b[5]))


def test_grid_joins_match_brute_force(spark):
    rng = random.Random(2)
    for far, cell in ((700, 150.0),):
        ones, others = made(rng, 80, far), made(rng, 90, far) + [(9, 500, 0.0, 0.0, 1.0, 1.0)]
        a, b = spark.createDataFrame(ones + [(8, 700, 0.0, 0.0, 5.0, 5.0)], SCHEMA), spark.createDataFrame(others, SCHEMA)
        met = B.touching(a, b, ["page"], cell)
        got = [(r["id"], r["other_id"]) for r in met.where(B.intersects(B.box(), B.box("other_"))).collect()]
        want = {(x[1], y[1]) for x in ones for y in others if x[0] == y[0] and x[2] < y[4] and x[4] > y[2] and x[3] < y[5] and x[5] > y[3]}
        assert len(got) == len(set(got)) and set(got) == want
        got = {(r["id"], r["other_id"]) for r in met.where(B.contains(B.box(), B.box("other_"))).collect()}
        assert got == {(x[1], y[1]) for x in ones for y in others if x[0] == y[0] and x[2] <= y[2] and x[4] >= y[4] and x[3] <= y[3] and x[5] >= y[5]}
        near = {r["id"]: (r["distance"], r["other_id"]) for r in B.nearest(a, b, ["page"], cell).collect()}
        best = {x[1]: min((gap(x, y), y[1]) for y in others if y[0] == x[0]) for x in ones}
        assert set(near) == set(best) and all(abs(near[i][0] - best[i][0]) < 1e-9 for i in best) and all(near[i][1] == best[i][1] for i in best if best[i][0] == 0)


def test_algebra(spark):
    row = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0)], SCHEMA)
    other = {"left": F.lit(5.0), "top": F.lit(10.0), "right": F.lit(20.0), "bottom": F.lit(12.0)}
    got = row.select(
        B.intersects(B.box(), other).alias("touching_only"), B.area(B.union(B.box(), other)).alias("union"), B.area(B.intersection(B.box(), other)).alias("common"), B.area(B.expand(B.box(), 1.0)).alias("grown"), B.gap(B.box(), other).alias("gap")
    ).first()
    assert tuple(got) == (False, 240.0, 0.0, 144.0, 0.0)


def test_no_boxes(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0, 1.0)], SCHEMA)
    assert B.nearest(one, none, ["page"]).count() == 0 and B.nearest(none, one, ["page"]).count() == 0 and B.touching(one, none, ["page"]).count() == 0
