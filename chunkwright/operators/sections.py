"""Sections of markdown documents, and lookups of places in them: interval joins that keep doc_id as equality key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^#{1,6}\s+.+$"


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, ord, level, title, start_char, end_char, parent_ord.

    A section ends where the next heading of its level or a higher one starts. Both that place and
    the parent are sought among the document's own headings.
    """
    lines = docs.select("doc_id", F.length("text").alias("n"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    placed = lines.withColumn("start_char", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = placed.where(F.col("line").rlike(HEADING)).select(
        "doc_id", "n", "start_char", F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)).alias("level"), F.btrim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)).alias("title"), (F.row_number().over(w) - 1).alias("ord")
    )
    heads = heads.withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start_char")) - 1).cast("long"))
    levels = [1, 2, 3, 4, 5, 6]
    after = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    # the next start and the last ordinal at each level: six windows over one sort instead of a self-join
    nexts = heads.select("*", *[F.min(F.when(F.col("level") <= k, F.col("start_char"))).over(after).alias(f"next_{k}") for k in levels], *[F.max(F.when(F.col("level") < k, F.col("ord"))).over(before).alias(f"up_{k}") for k in levels])
    pick = lambda name: F.coalesce(*[F.when(F.col("level") == k, F.col(f"{name}_{k}")) for k in levels])
    return nexts.select("doc_id", "ord", "level", "title", "start_char", F.coalesce(pick("next"), F.col("n").cast("long")).alias("end_char"), pick("up").alias("parent_ord"))


def open_sections(found: DataFrame) -> DataFrame:
    """found with `inside`, the open sections after each heading, outermost first, and `at`, those that a place right at the heading touches.

    A section of level k is open while the last heading of level k or higher is its own: six running
    values over one sort by document. Right at a heading the sections that end there count too.
    """
    so_far = Window.partitionBy("doc_id").orderBy("start_char").rowsBetween(Window.unboundedPreceding, 0)
    own = F.struct("level", F.col("start_char").alias("s"), "title")
    stack = found.withColumns({f"open_{k}": F.last(F.when(F.col("level") <= k, own), ignorenulls=True).over(so_far) for k in range(1, 7)})
    inside = F.array_compact(F.array(*[F.when(F.col(f"open_{k}.level") == k, F.col(f"open_{k}")) for k in range(1, 7)]))
    stack = stack.select(*found.columns, inside.alias("inside"))
    ended = F.filter(F.lag("inside").over(Window.partitionBy("doc_id").orderBy("start_char")), lambda x: x["level"] >= F.col("level"))
    return stack.withColumn("at", F.array_sort(F.concat("inside", F.coalesce(ended, F.array_except("inside", "inside")))))


def heading_paths(points: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, chunk_index, path: titles of the sections around each start_char, outermost first.

    Places and headings are merged by position, and the sections open at the last heading are carried
    forward, so a document costs the sum of both, not their product.
    """
    heads = open_sections(found).select("doc_id", F.col("start_char").alias("pos"), F.lit(None).cast("long").alias("chunk_index"), F.struct(F.col("start_char").alias("s"), F.col("at.title").alias("at"), F.col("inside.title").alias("inside")).alias("head"))
    places = points.select("doc_id", F.col("start_char").alias("pos"), "chunk_index", F.lit(None).cast(heads.schema["head"].dataType).alias("head"))
    order = Window.partitionBy("doc_id").orderBy("pos", F.col("chunk_index").isNotNull(), "chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    last = heads.unionByName(places).withColumn("last", F.last("head", ignorenulls=True).over(order)).where("chunk_index IS NOT NULL")
    path = F.when(F.col("last.s") == F.col("pos"), F.col("last.at")).otherwise(F.col("last.inside"))
    return last.select("doc_id", "chunk_index", F.coalesce(F.array_join(path, " > "), F.lit("")).alias("path"))


def page_of(points: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, chunk_index, page: the page whose range holds start_char, else the nearest one."""
    hit = points.select("doc_id", "chunk_index", "start_char").join(pages.select("doc_id", "page", "from_char", "to_char"), "doc_id")
    inside = (F.col("from_char") <= F.col("start_char")) & (F.col("start_char") <= F.col("to_char"))
    distance = F.when(inside, -1).otherwise(F.least(F.abs(F.col("from_char") - F.col("start_char")), F.abs(F.col("to_char") - F.col("start_char"))))
    return hit.groupBy("doc_id", "chunk_index").agg(F.min_by("page", F.struct(distance, "page")).alias("page"))
