"""Enrichment of texts by a model, with a stored cache, retries, and rules where the model falls short.

The cache is a Parquet table keyed by a digest of text and options. A run sends only texts that the
cache doesn't answer: an anti-join by key leaves them, one row for each distinct text, and what the
model says is appended in one committed write, so a lost executor or a failed job adds nothing twice.
Failures are appended too, with their number of attempts, and come back until `retries` more have
been made; after that they count as answered, without fields.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chunkwright.operators.ordered import shared_dir

#: Further attempts after a failure, and the least confidence of an answer that stands alone.
RETRIES, LEAST_CONFIDENCE = 2, 0.6

CACHE = "key string, attempts int, failed boolean, fields map<string,string>, confidence double"

#: A model takes a text and returns its fields and how sure it is of them; an exception is a failure.
Model = Callable[[str], tuple[dict[str, str], float]]


def outline(text: str) -> tuple[dict[str, str], float]:
    """The offline default: the first sentence as title and the number of lines; surer of longer texts. Texts under 50 characters fail."""
    if len(text) < 50:
        raise ValueError("too short to judge")
    first = re.split(r"[.!?\n]", text, maxsplit=1)[0]
    fields = {"lines": str(text.count("\n") + 1)} | ({"title": first[:60]} if first else {})
    return fields, min(1.0, len(text) / 1000)


@dataclass
class Cache:
    """What the model has said, at path (on storage that all executors share)."""

    path: str
    options: dict = field(default_factory=dict)

    def key(self, text: Column) -> Column:
        return F.sha2(F.concat_ws("\x00", F.lit(json.dumps(self.options, sort_keys=True)), text), 256)

    def rows(self, spark: SparkSession) -> DataFrame:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            return spark.createDataFrame([], CACHE)
        return spark.read.schema(CACHE).parquet(self.path)

    def latest(self, spark: SparkSession) -> DataFrame:
        """One row for each key: the answer, else the last failure."""
        best = F.max_by(F.struct("attempts", "failed", "fields", "confidence"), F.struct(~F.col("failed"), "attempts"))
        return self.rows(spark).groupBy("key").agg(best.alias("x")).select("key", "x.*")


def _asked(texts: DataFrame, model: Model) -> DataFrame:
    """texts: key, text, attempts before. Returns CACHE rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text, attempts in zip(frame["key"], frame["text"], frame["attempts"]):
                try:
                    fields, confidence = model(text)
                    out.append((key, attempts + 1, False, fields, float(confidence)))
                except Exception:  # noqa: BLE001  a model's failure on one text is kept as one
                    out.append((key, attempts + 1, True, None, None))
            yield pd.DataFrame(out, columns=["key", "attempts", "failed", "fields", "confidence"])

    return texts.select("key", "text", "attempts").mapInPandas(run, CACHE)


def fill(texts: DataFrame, cache: Cache, model: Model = outline, retries: int = RETRIES) -> int:
    """Ask the model for the texts (a column text) that the cache doesn't answer; returns how often it was asked."""
    spark, asked = texts.sparkSession, 0
    wanted = texts.where("text IS NOT NULL").select(cache.key(F.col("text")).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    for _ in range(retries + 1):
        held = cache.latest(spark)
        answered = held.where(~F.col("failed") | (F.col("attempts") > retries)).select("key")
        open_ones = wanted.join(answered, "key", "left_anti").join(held.select("key", "attempts"), "key", "left").na.fill(0, ["attempts"])
        seen = Observation()
        _asked(open_ones, model).observe(seen, F.count("*").alias("asked"), F.count_if("failed").alias("failed")).write.mode("append").parquet(cache.path)
        asked += seen.get["asked"]
        if not seen.get["failed"]:
            break
    return asked


def merged(texts: DataFrame, cache: Cache, rules: Column, rules_confidence: Column, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """texts with fields, confidence and method: the model's answer, filled up from the rules where it is unsure, the rules alone where it failed.

    rules: a map of fields, rules_confidence: how sure the rules are.
    """
    held = cache.latest(texts.sparkSession).where("NOT failed").select("key", F.col("fields").alias("__said"), F.col("confidence").alias("__sure"))
    both = texts.withColumns({"__key": cache.key(F.col("text")), "__rules": rules, "__rules_sure": rules_confidence}).join(held, F.col("__key") == F.col("key"), "left")
    mixed = F.map_zip_with("__said", "__rules", lambda k, said, rule: F.coalesce(said, rule))
    failed, sure = F.col("__sure").isNull(), F.col("__sure") >= least
    return both.select(
        *texts.columns, F.when(failed, F.col("__rules")).when(sure, F.col("__said")).otherwise(mixed).alias("fields"),
        F.when(failed, F.col("__rules_sure")).when(sure, F.col("__sure")).otherwise((F.col("__sure") + F.col("__rules_sure")) / 2).alias("confidence"),
        F.when(failed, "rules").when(sure, "ai").otherwise("hybrid").alias("method"),
    )


def enrich(texts: DataFrame, rules: Column, rules_confidence: Column, cache: Cache | None = None, model: Model = outline, retries: int = RETRIES) -> DataFrame:
    """fill, then merged. Without a cache, one of the session's own is used for this run."""
    import uuid

    cache = cache or Cache(f"{shared_dir(texts.sparkSession)}/chunkwright/enriched-{uuid.uuid4().hex}")
    fill(texts, cache, model, retries)
    return merged(texts, cache, rules, rules_confidence)
