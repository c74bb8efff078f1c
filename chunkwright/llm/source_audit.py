"""Divergence between the sources of a language, by counts of terms in DuckDB shards.

Terms are runs of ASCII letters and of all characters outside ASCII, with A to Z lower-cased. Tasks
count the terms of their documents by language and source (a task passes its counts on whenever it
holds HELD of them, so counts of frequent terms are summed before the shuffle). The counts are dealt
out to hash shards of language and term, and each shard's task runs SQL in an in-memory DuckDB:

1. COUNT sums the counts and keeps the terms that occur in at least `least_docs` documents of their
   language. Spark adds up what is kept: N for each group of language and source, N and V for each
   language, and from these the smoothed shares p of each count.
2. SCORE gives the shard's part of the sum for each pair of sources, and each group's best terms.

Spark merges both. Only terms that both sources of a pair have meet in a shard. For all others one
of the two counts is 0, so its share is one number of its group, and Spark adds them from the number
of terms that a group has at each share: with f the term's value, a0 and b0 the shares of count 0,

    sum f(a, b) = sum over shared terms of f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)
                + sum over a's terms of f(a, b0) + sum over b's terms of f(a0, b)
                + (V - terms of a - terms of b) f(a0, b0)

All arithmetic is in integers: shares in 38-digit decimals, squares of at most 10^18 in longs.

Defined results: null text, language and source count as empty, and empty ones are values like any
other; texts are read whole; doc_ids play no part, so null and repeated ones and repeated rows count
as documents of their own; ties in rank go to the smaller item by UTF-8; a group without terms has
pairs but no terms; where a language keeps no term its pairs have value 0; a language with one
source has no pairs; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkwright.llm.common import Scratch, materialize, small_batches, text_of

LEAST_DOCS, TOP = 10, 10
#: Counts that a task holds before it passes them on.
HELD = 500_000
#: Rows of an Arrow batch that a task makes.
OUT_ROWS = 20_000
#: What a term's share is a multiple of, and what its count is raised by.
SCALE, RAISED = 1_000_000_000, 2

#: Bytes of terms stay (A to Z lower-cased), all others become spaces. Bytes from 128 are those of characters outside ASCII.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long, lang_n long, leads boolean"
PARTS = "lang string, source string, part string, item string, value long"

#: rows: COUNTS of the shard. leads: true in one row of each term.
COUNT_SQL = """
WITH terms AS (SELECT lang, term, sum(n) AS lang_n, min(source) AS first FROM rows GROUP BY lang, term HAVING sum(docs) >= {least_docs})
SELECT lang, source, term, n, CAST(lang_n AS BIGINT) AS lang_n, source = first AS leads FROM rows JOIN terms USING (lang, term)"""

#: rows: lang, source, term, p, p0, q of the shard.
SCORE_SQL = """
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(
  ((a.p - b.p) * (a.p - b.p)) // (a.p + b.p) - ((a.p - b.p0) * (a.p - b.p0)) // (a.p + b.p0)
  - ((a.p0 - b.p) * (a.p0 - b.p)) // (a.p0 + b.p) + ((a.p0 - b.p0) * (a.p0 - b.p0)) // (a.p0 + b.p0)) AS BIGINT) AS value
FROM rows a JOIN rows b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY a.lang, a.source, b.source
UNION ALL
SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) AS value FROM rows WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // (p + q) DESC, term) <= {top}"""


def term_counts(docs: DataFrame) -> DataFrame:
    """COUNTS: occurrences of a term in a group, and the documents that hold it; several rows for one term of a group."""
    target = T._parse_datatype_string(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(target)
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, seen) in held.items():
                terms, n, docs = list(counts), list(counts.values()), list(map(seen.__getitem__, counts))
                for at in range(0, len(terms), OUT_ROWS):
                    part = pa.array(terms[at : at + OUT_ROWS], pa.binary()).cast(pa.string())
                    columns = [pa.repeat(lang, len(part)), pa.repeat(source, len(part)), part, pa.array(n[at : at + OUT_ROWS], pa.int64()), pa.array(docs[at : at + OUT_ROWS], pa.int64())]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
            held.clear()

        for batch in batches:
            lang, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary())
            for i, group in enumerate(zip(lang, source)):
                terms = texts[i].as_py().translate(_TERM_BYTES).split()
                counts, seen = held.get(group) or held.setdefault(group, (Counter(), Counter()))
                size -= len(counts)
                counts.update(terms)
                seen.update(set(terms))
                size += len(counts)
                if size >= HELD:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    read = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))
    return small_batches(read).mapInArrow(run, target)


def in_shards(rows: DataFrame, loaded: str, sql: str, schema: str) -> DataFrame:
    """sql over each hash shard of lang and term of rows. loaded: the query over `arriving` that fills the table `rows`.

    The shard streams into DuckDB, so with sums in `loaded` only their groups are held.
    """
    target, source = T._parse_datatype_string(schema), rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        wanted, given = to_arrow_schema(target), to_arrow_schema(source)
        typed = lambda batch, to: pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, to)], schema=to)
        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as con:
            con.register("arriving", pa.RecordBatchReader.from_batches(given, (typed(batch, given) for batch in batches)))
            con.execute(f"CREATE TABLE rows AS {loaded}")
            for batch in con.sql(sql).to_arrow_reader(OUT_ROWS):
                yield typed(batch, wanted)

    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(shards, "lang", "term").mapInArrow(run, target)


def share(count: str | Column, total: str, kept: str) -> Column:
    """1 + SCALE * (count + RAISED) / (total + RAISED * kept), rounded down; null where no term is kept."""
    count = F.col(count) if isinstance(count, str) else count
    raised = (count.cast("decimal(27,0)") + F.lit(RAISED).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    below = F.nullif(F.col(total) + RAISED * F.col(kept), F.lit(0)).cast("decimal(20,0)")
    return (F.call_function("div", raised, below) + 1).cast("long")


def value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    with Scratch(docs.sparkSession) as scratch:
        summed = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM arriving GROUP BY lang, source, term"
        kept = scratch.keep(in_shards(term_counts(docs), summed, COUNT_SQL.format(least_docs=least_docs), KEPT))
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"), F.count_if("leads").alias("leads"))
        occurring = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
        groups = scratch.keep(occurring.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "terms", "leads"]))
        langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("leads").alias("kept"))
        groups = scratch.keep(groups.join(langs, "lang").withColumn("p0", share(F.lit(0), "total", "kept")).drop("leads"))
        shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "total", "kept").alias("p"), "p0", share("lang_n", "lang_total", "kept").alias("q"))
        shares = scratch.keep(shares)
        found = scratch.keep(in_shards(shares, "SELECT * FROM arriving", SCORE_SQL.format(top=top), PARTS))
        return materialize(ranked(_pairs(groups, shares, found)).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= top)))


def _pairs(groups: DataFrame, shares: DataFrame, found: DataFrame) -> DataFrame:
    """PARTS of all ordered pairs of a language's sources."""
    one = groups.select("lang", "source", "p0", "terms", "kept")
    pairs = one.join(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("item_p0"), F.col("terms").alias("item_terms")), "lang").where("source <> item")
    levels = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    alone = levels.join(pairs.select("lang", "source", "item", "item_p0"), ["lang", "source"])
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * value(F.col("p"), F.col("item_p0"))).alias("value"))
    both = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    neither = pairs.select("lang", "source", "item", ((F.col("kept") - F.col("terms") - F.col("item_terms")) * value(F.col("p0"), F.col("item_p0"))).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = neither.unionByName(alone).unionByName(turned(alone)).unionByName(both).unionByName(turned(both))
    return parts.groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def ranked(parts: DataFrame) -> DataFrame:
    """parts with their ranks. Where only the first are kept, Spark keeps those of each task before the shuffle."""
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))


#: The same from one plain count of every term for every group.
ORACLE = f"""WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 found AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
 terms AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
 groups AS (SELECT DISTINCT lang, source FROM docs),
 counts AS (SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL),
 dense AS (SELECT g.lang, g.source, t.term, coalesce(n, 0)::HUGEINT AS n FROM groups g JOIN terms t USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
 own AS (SELECT *, 1 + ({SCALE} * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM dense),
 whole AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL),
 shares AS (SELECT lang, term, 1 + ({SCALE} * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM whole),
 pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 parts AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
   LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM own JOIN shares USING (lang, term) WHERE n > 0 AND p > q),
 placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM placed WHERE part = 'pair' OR rank <= {TOP}"""
