"""The substring join against plain `in`."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from chunkwright.operators import containment as C
from chunkwright.operators.containment import containing, either_way


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_substrings_are_all_found(spark):
    rng, alphabet = random.Random(2), "abÉéßΣ日😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(60)] + [None, "", "x"]
    needles = [None, "", "x", "A", "É"]
    for _ in range(120):
        t = rng.choice(texts[:60])
        a = rng.randint(0, len(t))
        needles.append(t[a : a + rng.choice([1, 3, 7, 8, 9, 15, 60, 200])].upper() if rng.random() < 0.5 else t[a : a + rng.randint(1, 40)] + rng.choice(["", "", "q"]))
    low = lambda df: [r["t"] for r in df.selectExpr("id", "lower(text) AS t").orderBy("id").collect()]
    ns, ts = frame(spark, needles), frame(spark, texts)
    want = {(i, j) for i, n in enumerate(low(ns)) for j, t in enumerate(low(ts)) if n and t and n in t}
    got = [tuple(r) for r in containing(ns, ts).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_either_way_and_empty_sides(spark):
    ones, others = frame(spark, ["whole sentence here", "part"]), frame(spark, ["SENTENCE", "a part of it", "whole sentence here"])
    assert {tuple(r) for r in either_way(ones, others).collect()} == {(0, 0), (1, 1), (0, 2)}
    assert either_way(ones, frame(spark, [])).count() == 0 and containing(frame(spark, []), others).count() == 0


def test_no_cross_join(spark):
    plan = containing(frame(spark, ["abcdefghijkl"] * 3), frame(spark, ["abcdefghijklmnop"] * 3))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_grams_are_passed_on_before_they_grow_with_the_batch():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(4000)) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    lengths, rows, largest = [6, 7, 8], 0, 0
    tracemalloc.start()
    for out in C.gram_batches([batch], lengths):
        rows, largest = rows + out.num_rows, max(largest, out.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == sum(len({t[i : i + q] for i in range(len(t) - q + 1)}) for t in texts for q in lengths)
    assert largest < C.PASSED_ON + 4000 * len(lengths) and peak < 40e6  # all of the batch's took 20 bytes each, twice


def test_unset_bits_keep_grams_where_they_are_found():
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array(["abcdef", "xyz"])], names=["id", "text"])
    bits = np.zeros(C.BITS, bool)
    wanted = {int(C.gram_hashes("cd", 2)[0]), int(C.gram_hashes("a", 1)[0])}
    bits[[g % C.BITS for g in wanted]] = True
    assert {(r["id"], r["q"], r["gram"]) for out in C.gram_batches([batch], [1, 2], bits) for r in out.to_pylist()} == {(7, 2, int(C.gram_hashes("cd", 2)[0])), (7, 1, int(C.gram_hashes("a", 1)[0]))}


def test_bits_are_those_of_the_grams(spark):
    grams = [0, 1, 63, 64, C.BITS - 1, C.BITS + 5, (1 << 63) - 1]
    packed = C._bits_of(spark.createDataFrame([(g,) for g in grams], "gram long")).value
    assert np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")).tolist() == sorted({g % C.BITS for g in grams})
