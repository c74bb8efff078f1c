"""Reader queries over the pages table, as if each page were a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwright.plans.corpora import DUCK_CONVERSATIONS, conversations_markdown, table
from chunkwright.plans.registry import query
from chunkwright.sources import readers


@query("s04_html_reader")
def html_reader(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return readers.parse(files).select("path", "reader", "text", F.col("hints")["title"].alias("title"), F.size("errors").alias("n_errors"))


@query("s05a_csv_reader", "SELECT n_regionkey || '.csv' AS path, count(*) AS row_count, 2 AS column_count FROM nation GROUP BY n_regionkey")
def csv_reader(spark, sf_dir):
    row = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name")
    files = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("key,name\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("t"))
    parsed = readers.parse(files.select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("path"), F.encode("t", "UTF-8").alias("content")))
    return parsed.select("path", F.col("hints")["row_count"].cast("long").alias("row_count"), F.col("hints")["column_count"].cast("int").alias("column_count"))


@query(
    "s03_markdown_reader",
    f"""WITH {DUCK_CONVERSATIONS}, h AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^# (.*)$', '<!-- HEADING_START:H1 -->' || chr(10) || '# \\1' || chr(10) || '<!-- HEADING_END:H1 -->', 'g'), '(?m)^## (.*)$', '<!-- HEADING_START:H2 -->' || chr(10) || '## \\1' || chr(10) || '<!-- HEADING_END:H2 -->', 'g') AS text FROM markdown)
    SELECT doc_id, trim(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM h""",
)
def markdown_reader(spark, sf_dir):
    """Conversations as markdown files, read like files."""
    files = conversations_markdown(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return readers.parse(files).select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("doc_id"), "text")
