"""Inputs of the queries: tables, and structured texts derived from them in both engines by one rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes for each core below which a table is dealt out anew: its few row groups would keep few cores busy.
SMALL = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of few bytes for each core is dealt out over all cores, larger ones stay as they are stored."""
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path)
    jvm_path, cores = spark._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext.defaultParallelism
    size = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jvm_path).getLength()
    return found.repartition(cores) if (1 << 20) < size < SMALL * cores else found


#: What a line becomes, by (place in its document + doc_id) mod 20; l is the line, i its place from 0. Every line stays whole.
_DECOR = """CASE (i + doc_id) % 20
 WHEN 0 THEN '#### ' || l WHEN 1 THEN '1. ' || l WHEN 2 THEN '- ' || l WHEN 3 THEN '          - ' || l
 WHEN 4 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || l || ' |'
 WHEN 5 THEN l || chr(10) WHEN 6 THEN '## (see below)' || chr(10) || l WHEN 7 THEN '###' || chr(10) || l
 WHEN 8 THEN 'Page 3 of 9' || chr(10) || l WHEN 9 THEN l || '   ' WHEN 10 THEN 'Intro ....... 12' || chr(10) || l WHEN 11 THEN '[Figure] ' || l
 WHEN 12 THEN '3-1. ' || l WHEN 13 THEN '(2) ' || l || chr(10) || chr(10) || chr(10) || chr(10)
 WHEN 14 THEN '## ' || substr(l, 1, 40) || chr(10) || l WHEN 15 THEN 'CONFIDENTIAL' || chr(10) || l WHEN 16 THEN '# Paragraph 4' || chr(10) || l
 WHEN 17 THEN '```python' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || l WHEN 18 THEN l || chr(10) || '- 12 -' ELSE l END"""


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: documents whose lines carry headings, lists, tables, fences and page furniture."""
    line = _DECOR.replace("chr(10)", "'\\n'")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.expr(f"array_join(transform(split(text, '\\n'), (l, i) -> {line}), '\\n')").alias("text"))


DUCK_DECORATED = f"""decorated AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, j: {_DECOR.replace("(i + doc_id)", "(j - 1 + doc_id)")}), chr(10)) AS text
 FROM documents WHERE text IS NOT NULL)"""


def conversations_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: each conversation as a markdown document, a section for each turn."""
    turns = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), "text")
    return (
        turns.groupBy(F.col("conv_id").alias("doc_id"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
        .select("doc_id", F.concat(F.lit("# Conversation "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.array_join(F.col("parts.part"), "\n\n")).alias("text"))
    )


DUCK_CONVERSATIONS = """markdown AS (SELECT conv_id AS doc_id, '# Conversation ' || conv_id || chr(10) || chr(10) ||
 string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, '## ' || role || ' ' || turn || chr(10) || chr(10) || text) AS text FROM conversations GROUP BY conv_id)"""

CHUNK, OVERLAP = 1024, 128


def chunks(spark: SparkSession, sf_dir: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, content: documents in windows of `size` characters that share `overlap`."""
    from chunkwright.operators.chunking import fixed_windows

    return fixed_windows(table(spark, sf_dir, "documents").where("length(text) > 0"), size, overlap).select("doc_id", "chunk_index", "content")


DUCK_CHUNKS = f"""chunks AS (SELECT doc_id, chunk_index, substr(text, CAST(chunk_index * {CHUNK - OVERLAP} + 1 AS BIGINT), {CHUNK}) AS content FROM (
 SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - {OVERLAP}) / {CHUNK - OVERLAP}.0) AS BIGINT)))) AS chunk_index FROM documents WHERE length(text) > 0))"""
