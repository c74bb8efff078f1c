"""Boxes of text lines and figures: documents laid out on pages of forty lines, every seventh line followed by a figure."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwright.operators import boxes as B
from chunkwright.plans.corpora import table
from chunkwright.plans.registry import query

SPACE = ["doc_id", "page"]
_LEFT, _TOP = "72e0 + 10 * (i % 3)", "72e0 + (i % 40) * 14"
_BLOCK = {"left": _LEFT, "top": _TOP, "right": f"{_LEFT} + least(length(line), 90) * 5e0", "bottom": f"{_TOP} + 12"}
_FIGURE = {"left": "90e0 + (doc_id % 5) * 60", "top": f"{_TOP} - 10", "right": "90e0 + (doc_id % 5) * 60 + 60 + length(line) % 300", "bottom": f"{_TOP} + 20 + length(line) % 90"}
#: Figures of every third document stand at the foot of the page, away from its lines.
_FIGURE = {s: x if s in ("left", "right") else f"({x} + CASE WHEN doc_id % 3 = 0 THEN 700 ELSE 0 END)" for s, x in _FIGURE.items()}


def _lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return docs.withColumn("page", F.expr("i div 40"))


def blocks(spark, sf_dir):
    return _lines(spark, sf_dir).where("line <> ''").select(*SPACE, F.col("i").alias("id"), *[F.expr(x).cast("double").alias(s) for s, x in _BLOCK.items()])


def figures(spark, sf_dir):
    return _lines(spark, sf_dir).where("i % 7 = 3 OR i = 0").select(*SPACE, F.col("i").alias("id"), *[F.expr(x).cast("double").alias(s) for s, x in _FIGURE.items()])


_SIDE = lambda rule: ", ".join(f'CAST({x} AS DOUBLE) AS "{s}"' for s, x in rule.items())
_DUCK = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
 b AS (SELECT doc_id, i // 40 AS page, i AS id, {_SIDE(_BLOCK)} FROM l WHERE line <> ''), f AS (SELECT doc_id, i // 40 AS page, i AS id, {_SIDE(_FIGURE)} FROM l WHERE i % 7 = 3 OR i = 0),
 p AS (SELECT f.doc_id, f.page, f.id, b.id AS other_id, f."left" AS l1, f."top" AS t1, f."right" AS r1, f."bottom" AS b1, b."left" AS l2, b."top" AS t2, b."right" AS r2, b."bottom" AS b2 FROM f JOIN b USING (doc_id, page)),
 q AS (SELECT *, sqrt(greatest(0, l2 - r1, l1 - r2) ** 2 + greatest(0, t2 - b1, t1 - b2) ** 2) AS distance FROM p)"""


@query(
    "x14_figures_and_lines",
    f"""WITH {_DUCK} SELECT doc_id, page, id, other_id, l1 <= l2 AND r1 >= r2 AND t1 <= t2 AND b1 >= b2 AS contains, round(greatest(0, least(r1, r2) - greatest(l1, l2)) * greatest(0, least(b1, b2) - greatest(t1, t2)), 6) AS common_area,
    round((greatest(r1, r2) - least(l1, l2)) * (greatest(b1, b2) - least(t1, t2)), 6) AS union_area FROM q WHERE l1 < r2 AND r1 > l2 AND t1 < b2 AND b1 > t2""",
)
def figures_and_lines(spark, sf_dir):
    """Figures and the lines that they cover in part or whole, by grid cells."""
    met = B.touching(figures(spark, sf_dir), blocks(spark, sf_dir), SPACE)
    one, other = B.box(), B.box("other_")
    return met.where(B.intersects(one, other)).select(
        *SPACE, "id", "other_id", B.contains(one, other).alias("contains"), F.round(B.area(B.intersection(one, other)), 6).alias("common_area"), F.round(B.area(B.union(one, other)), 6).alias("union_area")
    )


@query(
    "x14_nearest_lines",
    f"""WITH {_DUCK}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, id ORDER BY distance, other_id) AS k FROM q), m AS (SELECT doc_id, page, id, count(*) FILTER (WHERE l1 - 10 < r2 AND r1 + 10 > l2 AND t1 - 10 < b2 AND b1 + 10 > t2) AS in_margin FROM q GROUP BY 1, 2, 3)
    SELECT n.doc_id, n.page, n.id, other_id, round(distance, 6) AS distance, in_margin FROM n JOIN m USING (doc_id, page, id) WHERE k = 1""",
)
def nearest_lines(spark, sf_dir):
    """The line nearest to each figure, and how many stand within ten points of it."""
    lines, pictures = blocks(spark, sf_dir), figures(spark, sf_dir)
    near = B.nearest(pictures, lines, SPACE).select(*SPACE, "id", "other_id", F.round("distance", 6).alias("distance"))
    grown = pictures.select(*SPACE, "id", *[c.alias(s) for s, c in B.expand(B.box(), F.lit(10.0)).items()])
    margins = B.touching(grown, lines, SPACE).where(B.intersects(B.box(), B.box("other_"))).groupBy(*SPACE, "id").agg(F.count("*").alias("in_margin"))
    return near.join(margins, [*SPACE, "id"], "left").na.fill(0, ["in_margin"])
