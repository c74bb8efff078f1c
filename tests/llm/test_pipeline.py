"""The pipeline's stages on planted documents, each against what it should keep."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chunkwright.llm import packing
from tests.llm.helpers import SCHEMA, awkward, docs, prose, words

COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(41)
    item = " ".join(words(rng, 40))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = words(rng, 60)
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(60), rng.choice(["grub", "mudface", "vilekin"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    clean = [i for i, t in rows if i % 4]
    near = rows[clean[0]][1].split()
    near[30] = "changed"
    rows += [(1000, " ".join(near)), (1001, rows[clean[1]][1]), (1002, f"{prose(rng, 60)} {item} {prose(rng, 60)}"), (1003, f"{prose(rng, 60)} password=abcdefgh12345 {prose(rng, 20)}"), (1004, None)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", f"s{i % 5}", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), clean


def test_stages_keep_what_they_should(spark, planted):
    folder, clean = planted
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS
        rows = out.collect()
        ids[name] = sorted(r["doc_id"] for r in rows)
        docs = spark.createDataFrame(rows, SCHEMA)
    extra = [1000, 1001, 1002, 1003, 1004]
    assert ids["toxicity"] == sorted(clean + extra)
    assert ids["near_dedup"] == sorted(clean + [1002, 1003, 1004])
    assert ids["decontamination"] == ids["secrets"] == sorted(clean + [1003, 1004])
    assert "[secret]" in docs.where("doc_id = 1003").first()["text"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.columns == packing.PIECES.replace(" long", "").split(", ") + ["sequence_id", "offset"]


def test_run_gives_the_last_stage(spark, planted):
    folder, clean = planted
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert set(got.doc_id) == {*clean, 1003, 1004} and got.groupby("sequence_id").length.sum().max() <= 1024


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_run_on_odd_and_empty_tables(spark, tmp_path, name):
    texts, ids = awkward(random.Random(51)) if name == "odd" else ([], [])
    frame = docs(spark, texts, ids)
    for column in ("key", "row", "text_key", "gone", "__id"):
        frame = frame.withColumn(column, F.lit("x"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).where("start = 0").toPandas()
    # one row of the texts without words, one of each other text: "one", the short and the long prose
    assert len(got) == (4 if name == "odd" else 0) and set(got.doc_id.dropna()) <= {1, 2, 3, 4, 5, 6}
