"""From raw documents to packed sequences.

Stages, in order: toxic documents go; one document of each group of near duplicates stays; documents
that leak benchmark items go; secrets that aren't copied examples are replaced in the texts (their
documents stay); what is left is packed. Each stage is written as Parquet and read again by the next;
a stage's table is dropped when the next one's is written, the last when the driver's process ends.

Defined results: null texts count as empty, score as not toxic, are near duplicates of all texts
without words, leak nothing, hold no secrets, and are packed as the closing token alone; very long
texts are read whole; null or repeated doc_ids are kept as they are, and every filter goes by the
text; of repeated rows, as of any near duplicates, one stays; ties between duplicates go to the
smallest doc_id; an empty table, benchmark or table of labels gives an empty, undecontaminated or
unfiltered result; all columns of documents, extra ones too, pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chunkwright.llm import decontaminate, order_minhash, packing, secret_scan, toxicity
from chunkwright.llm.common import checkpoint_dir, delete, drop_at_exit


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose texts score under the threshold; the model is learned from labels outside the held-out fold."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that with the smallest doc_id."""
    return order_minhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose texts hold no leak of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; spans that aren't copied examples are replaced, and n_chars follows the text."""
    return secret_scan.redact(docs, ["source"], ["source", "lang"])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; see chunkwright.llm.packing."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Learned scores, sketches and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            delete(spark, before)
        before = f"{folder}/{name}"
    return docs
