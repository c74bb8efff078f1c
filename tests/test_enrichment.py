"""The enrichment cache: what is asked, how often, and what is made of the answers."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from chunkwright.operators import enrichment as N


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def merged(df, cache):
    rules = F.create_map(F.lit("title"), F.lit("rule"), F.lit("language"), F.lit("en"))
    return {r["doc_id"]: (r["method"], r["confidence"], r["fields"]) for r in N.merged(df, cache, rules, F.lit(1.0)).collect()}


def test_a_second_run_asks_nothing(spark, tmp_path):
    texts = [f"text number {i % 30} " * 10 for i in range(90)] + [None, "short", "short"]
    cache = N.Cache(str(tmp_path / "cache"))
    assert N.fill(docs(spark, texts), cache) == 30 + 3  # each distinct text once, the short one three times
    assert N.fill(docs(spark, texts), cache) == 0
    assert N.fill(docs(spark, texts + ["a new text that is long enough to be judged by the model"] * 2), cache) == 1
    assert cache.latest(spark).count() == 32 and cache.rows(spark).count() == 34
    assert N.fill(docs(spark, texts), N.Cache(cache.path, {"model": "other"})) == 33  # other options are other keys


def test_failures_come_back_and_are_answered_once_they_succeed(spark, tmp_path):
    folder = str(tmp_path / "calls")
    os.makedirs(folder)

    def flaky(text):
        """Fails as often as the text says; calls are counted by files."""
        wanted, name = text.split()
        before = len([f for f in os.listdir(folder) if f.startswith(f"{name}-")])
        open(f"{folder}/{name}-{before}", "w").close()
        if before < int(wanted):
            raise RuntimeError("busy")
        return {"title": name}, 0.9

    df = docs(spark, ["0 a", "1 b", "2 c", "9 d"]).coalesce(1)
    cache = N.Cache(str(tmp_path / "cache"))
    assert N.fill(df, cache, flaky, retries=2) == 1 + 2 + 3 + 3
    assert N.fill(df, cache, flaky, retries=2) == 0
    state = {r["fields"]["title"] if r["fields"] else "d": (r["attempts"], r["failed"]) for r in cache.latest(spark).collect()}
    assert state == {"a": (1, False), "b": (2, False), "c": (3, False), "d": (3, True)}
    assert merged(df, cache)[3] == ("rules", 1.0, {"title": "rule", "language": "en"})
    assert N.fill(df, cache, flaky, retries=9) == 6 + 1  # more retries take it up where it stood: it has failed three times, fails six more and answers


def test_unsure_answers_are_filled_up_by_rules(spark, tmp_path):
    answers = {"sure": ({"title": "said"}, 0.6), "unsure": ({"topic": "t", "title": "said"}, 0.2), "empty": ({}, 0.0)}
    df = docs(spark, list(answers))
    cache = N.Cache(str(tmp_path / "cache"))
    N.fill(df, cache, lambda text: answers[text])
    got = merged(df, cache)
    assert got[0] == ("ai", 0.6, {"title": "said"})
    assert got[1] == ("hybrid", 0.6, {"topic": "t", "title": "said", "language": "en"})
    assert got[2] == ("hybrid", 0.5, {"title": "rule", "language": "en"})


def test_an_empty_table(spark, tmp_path):
    cache = N.Cache(str(tmp_path / "cache"))
    assert N.fill(docs(spark, []), cache) == 0 and merged(docs(spark, []), cache) == {}
