"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkwright.llm import decontaminate, exact_dedup, fill_in_middle, html_blocks, link_trust, order_minhash, packing, repetition, secret_scan, sharding, source_audit, suffix_repeats, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: source. Repository: source and language."""
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents"), ["source"], ["source", "lang"]))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the smallest doc_id of its class of near duplicates, and the class's number of rows."""
    return order_minhash.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document scored by the grammar learned from labels outside the held-out fold."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the base counts, coverage by repeated n-grams and lines, and the verdict."""
    return repetition.measure(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with its host, path, rule and verdict, and the scores of its host."""
    return link_trust.judge(_table(spark, sf_dir, "pages"))


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage of 50 words or more that stands in another document too, as a range of words."""
    return suffix_repeats.repeats(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in one of 24 shards of nearly equal bytes."""
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=24)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's main text."""
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of a document in a sequence of 1024 tokens at most."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of a document and a benchmark item that it leaks, verbatim or with new values."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of a language's sources with their divergence, and each source's ten most typical terms."""
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document cut at unit boundaries and put together around markers."""
    return fill_in_middle.digest(fill_in_middle.transform(_table(spark, sf_dir, "documents")))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one that stays of those with the same text."""
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_near_dedup": op2_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_repeats": op6_suffix_repeats,
    "op7_sharding": op7_sharding,
    "op8_html_extraction": op8_html_extraction,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_source_audit": op11_source_audit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secret_scan.ORACLE,
    "op11_source_audit": source_audit.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_exact_dedup": exact_dedup.ORACLE,
}
