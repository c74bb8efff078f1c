"""Frequent words with bounded counters, late chunks and multi-hop questions against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chunkwright.functions import models
from chunkwright.operators import graph as G
from chunkwright.operators import late as T
from chunkwright.operators.heavy import most_frequent, top_words


def best(words, k):
    return [w for w, _ in sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[:k]]


@pytest.mark.parametrize("counters", [4, 40, 2000])
def test_top_words_are_exact_with_few_counters(spark, counters):
    rng = random.Random(counters)
    skewed = [f"w{i}" for i in range(300) for _ in range(1 + 2000 // (i + 1))]
    flat = [f"f{i}" for i in range(500)]
    rows = [("skewed", [rng.choice(skewed) for _ in range(50)]) for _ in range(200)] + [("flat", [rng.choice(flat) for _ in range(50)]) for _ in range(60)] + [("few", ["a", "b", "a"]), ("none", []), (None, ["x"]), ("null", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "grp string, words array<string>").where("grp IS NOT NULL").repartition(5)
    got = {}
    for r in sorted(top_words(df, 10, counters).collect(), key=lambda r: (r["grp"], r["rank"])):
        got.setdefault(r["grp"], []).append(r["w"])
    want = {}
    for grp, words in rows:
        if grp is not None:
            want.setdefault(grp, []).extend(words or [])
    assert got == {g: best(w, 10) for g, w in want.items() if w}


def test_most_frequent_of_one_text(spark):
    rng = random.Random(1)
    rows = [[rng.choice("abcdef") for _ in range(n)] for n in (0, 1, 2, 10, 500)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, words array<string>")
    assert [r["x"] for r in df.orderBy("i").select(most_frequent(F.col("words"), 3).alias("x")).collect()] == [best(r, 3) for r in rows]


def test_late_boundaries_and_means(spark):
    rng = random.Random(3)
    texts = ["", "one", "a b  c\nd", " ".join("word." if rng.random() < 0.1 else "word" for _ in range(2500)), "x" * 4000, "s. " * 401]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    spans = T.boundaries(docs)
    rows = spans.collect()
    for i, text in enumerate(texts):
        own = sorted((r["index"], r["start_char"], r["end_char"]) for r in rows if r["doc_id"] == i)
        assert [o[0] for o in own] == list(range(len(own))) and (not text or (own[0][1] == 0 and own[-1][2] == len(text)))
        assert all(e - s <= T.MOST for _, s, e in own) and all(own[k][2] - T.OVERLAP == own[k + 1][1] for k in range(len(own) - 1))
    words = T.word_places(docs)
    assert all(texts[r["doc_id"]][r["at"] : r["at"] + len(r["word"])] == r["word"] for r in words.collect())
    tokens = words.select("doc_id", "at", F.array((F.col("at") / 4.0), F.length("word").cast("double")).alias("vector"))
    got = {(r["doc_id"], r["index"]): (r["n"], r["sums"]) for r in T.pooled(tokens, spans, 2).collect()}
    placed = words.collect()
    for r in rows:
        inside = [w for w in placed if w["doc_id"] == r["doc_id"] and r["start_char"] <= w["at"] < r["end_char"]]
        want = (len(inside), [sum(round(w["at"] / 4 * T.UNIT) for w in inside), sum(len(w["word"]) * T.UNIT for w in inside)])
        assert got.get((r["doc_id"], r["index"]), (0, [0, 0])) == want


def test_multi_hop_questions_are_filtered_and_once_only(spark):
    text = "The turbine spins. Nothing else."
    chunks = spark.createDataFrame([(1, 0, text), (1, 1, "A turbine breaks here."), (1, 2, "Unrelated words."), (2, 0, text), (2, 1, "The turbine. " + "filler words galore " * 9), (3, 0, None), (3, 1, text)], "doc_id long, chunk_index long, text string")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 0, 2), (2, 0, 1), (3, 0, 1)], "doc_id long, src long, dst long")
    got = G.multi_hop(chunks, edges, models.bridge).collect()
    assert [(r["doc_id"], r["src"], r["dst"], r["question"], r["answer"], r["rank"]) for r in got] == [(2, 0, 1, "What do both passages say about turbine?", "The turbine spins / The turbine", 1)]
    assert G.multi_hop(chunks, edges, models.bridge, least=0.9).count() == 0
