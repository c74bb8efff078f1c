"""All queries of the engine and their DuckDB SQL; importing the plan modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.functions import scores as S
from chunkwright.functions.rewrite import RULES, column, duckdb
from chunkwright.operators.chunking import fixed_windows
from chunkwright.plans import analysis, assembly, graphs, language, layout, markdown, metadata, more, quality, readers, reports, scoring, streams, structure, text, vectors  # noqa: F401
from chunkwright.plans.corpora import table
from chunkwright.plans.registry import ORACLES, QUERIES, query  # noqa: F401

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refine the documents, cut them into chunks, score the chunks and summarise by source."""
    text_column = column(column(F.col("text"), RULES["clean_noise"]), RULES["normalize_whitespace"])
    refined = table(spark, sf_dir, "documents").select("doc_id", "source", text_column.alias("text")).where("length(text) > 0")
    chunks, c = S.derived(fixed_windows(refined, 1024, 128, "source"))
    return chunks.groupBy("source").agg(
        F.count("*").alias("n_chunks"), F.round(F.avg(F.length(c.text)), 6).alias("mean_chars"), F.round(F.avg(S.completeness(c)), 6).alias("completeness"),
        F.round(F.avg(S.density(c)), 6).alias("density"), F.round(F.avg(S.per_thousand(c)), 6).alias("per_thousand"),
    )


_REFINED = duckdb(duckdb("text", RULES["clean_noise"]), RULES["normalize_whitespace"])

query(
    "flagship",
    f"""WITH refined AS (SELECT doc_id, source, {_REFINED} AS text FROM documents), chunks AS (SELECT source, substr(text, CAST(i * 896 + 1 AS BIGINT), 1024) AS content FROM (
      SELECT source, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 128) / 896.0) AS BIGINT)))) AS i FROM refined WHERE length(text) > 0))
    SELECT source, count(*) AS n_chunks, round(avg(length(content)), 6) AS mean_chars, round(avg({scoring.D_COMPLETENESS}), 6) AS completeness, round(avg({scoring.D_DENSITY}), 6) AS density,
      round(avg({scoring.D_PER_THOUSAND}), 6) AS per_thousand FROM chunks GROUP BY source""",
)(flagship)
