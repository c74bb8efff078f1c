"""Bounded chunks, sentence rules and array helpers on texts made for them."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from chunkwright.functions import profiles as V
from chunkwright.functions.arrays import kept_by, running_sums
from chunkwright.operators import assembly as A


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 65, 5000])
def test_running_sums(spark, n):
    df = spark.createDataFrame([(list(range(n)),)], "v array<int>")
    assert df.select(running_sums(F.col("v")).alias("x")).first()["x"] == list(itertools.accumulate(range(n)))


@pytest.mark.parametrize("n", [0, 1, 70, 3000])
def test_kept_by_keeps_items_in_order(spark, n):
    df = spark.createDataFrame([(list(range(n)),)], "v array<int>")
    kept = kept_by(F.col("v"), {"seen": F.lit(0)}, lambda a, x: ({"seen": a["seen"] + 1}, x % 3 != 1, a["seen"] * 2), "int")
    assert df.select(kept.alias("x")).first()["x"] == [2 * i for i in range(n) if i % 3 != 1]


def texts(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 30))).capitalize() + rng.choice([". ", "! ", "? "])
    paragraph = lambda: "".join(sentence() for _ in range(rng.randint(1, 40)))
    found = ["\n\n".join(paragraph() for _ in range(rng.randint(1, 9))) for _ in range(30)]
    return found + ["x" * 5000, "", "\n\n\n\n", "a. " * 900, f"{'y' * 3000}\n\nshort\n\nb.\n\nc.\n\n{'z ' * 1500}", "no end " * 400, "Dr. No " * 500]


def test_no_chunk_is_over_its_bound_and_nothing_is_lost(spark):
    rows = list(enumerate(texts(random.Random(5))))
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    chunks = A.assemble(docs).select("doc_id", "chunk_index", "start_char", "end_char", "strategy").collect()
    by = dict(rows)
    assert chunks and max(c["end_char"] - c["start_char"] for c in chunks) <= A.SIZE
    assert {c["strategy"] for c in chunks} == {"Sentence", "Paragraph", "Token"}
    for doc_id, text in rows:
        covered = {k for c in chunks if c["doc_id"] == doc_id for k in range(c["start_char"], c["end_char"])}
        assert all(k in covered for k, x in enumerate(text) if not x.isspace())
        own = sorted((c for c in chunks if c["doc_id"] == doc_id), key=lambda c: c["chunk_index"])
        assert [c["chunk_index"] for c in own] == list(range(len(own))) and all(c["end_char"] <= len(by[doc_id]) for c in own)


def test_parts_split_at_sentences_before_they_are_cut(spark):
    text = ("A" * 400 + ". ") * 2 + "B" * 2500 + ". " + "C" * 10 + "."
    docs = V.with_rules(spark.createDataFrame([(1, 7, text, "en")], "doc_id long, start_char long, text string, lang string"))
    got = A.bounded_chunks(docs).orderBy("start_char").collect()
    assert "".join(r["content"] for r in got) == text and [len(r["content"]) for r in got] == [804, 1024, 1024, 465]
    assert [r["start_char"] for r in got] == [7, 811, 1835, 2859]


@pytest.mark.parametrize(
    "language, text, ends, complete",
    [
        ("en", "Dr. Smith left. He met Mr. Jones in the U.S. yesterday", [16], True),
        ("en", 'He said "stop!" Then (it ended.)', [14, 31], True),
        ("de", "Das ist z.B. gut. Nr. 5 usw. bleibt", [18], True),
        ("fr", "Que dit-il ? Voir fig. 3.", [13, 25], True),
        ("ko", "책을 읽었습니다. 모두 등. 끝", [8, 10], True),
        ("zh", "第一。第二！完", [3, 6], True),
        ("ja", "文です。次も文です 終", [4, 10], True),
        ("hi", "एक है। दो", [7], True),
        ("ar", "جملة. سؤال؟ ثم", [6, 12], True),
        ("ru", "В 1990 г. был. Да", [15], True),
        ("pt", "Na pág. 3 ontem. Fim", [17], True),
        ("es", "La Sra. dijo ¡Nada! Fin", [20], True),
        ("en", "No end. " + "so far " * 9, [8], False),
        ("en", "", [], False),
        ("en", "   ", [], False),
    ],
)
def test_sentence_rules(spark, language, text, ends, complete):
    rule = {r["language"]: r for r in V.rules(spark).collect()}[language]
    df = spark.createDataFrame([(text, rule["ends"], rule["abbreviations"])], "text string, ends string, abbreviations array<string>")
    row = df.select(V.boundaries(F.col("text")).alias("at"), V.ends_complete(F.col("text")).alias("complete"), V.sentences(F.col("text")).alias("s")).first()
    assert row["at"] == ends and row["complete"] == complete and "".join(row["s"]) == text


def test_language_comes_from_script_then_declaration(spark):
    rows = [("한국어 문장입니다", "en"), ("plain text", "de"), ("plain text", "xx"), ("plain text", None), ("Это текст", None), ("plain text", "pt-BR"), ("plain text", "FR_ca")]
    got = spark.createDataFrame(rows, "text string, lang string").select(V.found_language(F.col("text"), F.col("lang")).alias("l")).collect()
    assert [r["l"] for r in got] == ["ko", "de", "en", "en", "ru", "pt", "fr"]


def test_section_tree_chunks_are_bounded_linked_and_whole(spark):
    from chunkwright.operators import hierarchy as H

    rng = random.Random(9)
    line = lambda: " ".join("word" for _ in range(rng.randint(1, 40))) + "."
    made = []
    for i in range(25):
        rows = [line() for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(0, 25)):
            rows += ["#" * rng.randint(1, 5) + f" Heading {rng.randint(1, 99)}"] + [line() for _ in range(rng.choice([0, 1, 2, 2, 9]))]
        made.append((i, "\n".join(rows), "en"))
    made += [(100, "", "en"), (101, "# only a heading", "en"), (102, "x" * 3000, None), (103, None, "en")]
    got = H.hierarchical_chunks(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], {})[r["chunk_index"]] = r
    assert set(by) == {i for i, t, _ in made if t is not None} and max(len(r["content"]) for r in got) <= A.SIZE
    for doc_id, text, _ in made[:-1]:
        chunks = by[doc_id]
        assert sorted(chunks) == list(range(len(chunks))) and chunks[0]["kind"] == "Root" and chunks[0]["parent_index"] is None
        assert all(text[r["start_char"] : r["start_char"] + len(r["content"])] == r["content"] for r in chunks.values())
        covered = {k for r in chunks.values() for k in range(r["start_char"], r["start_char"] + len(r["content"]))}
        assert all(k in covered for k, x in enumerate(text) if not x.isspace())
        for k, r in chunks.items():
            assert all(chunks[c]["parent_index"] == k for c in r["children"])
            assert r["parent_index"] is None or k in chunks[r["parent_index"]]["children"]
            assert (r["kind"] == "Leaf") == (not r["children"] and k > 0)
            if r["parent_index"] is not None:
                assert chunks[r["parent_index"]]["level"] <= r["level"]
