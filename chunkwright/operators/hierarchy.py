"""Hierarchical chunks over the section tree.

A document is a tree of sections (id, parent) under a root that holds what stands before the first
heading. A section's subtree is one stretch of text, so its size is known from its ends, and what
becomes of a section follows from its parent alone:

- the largest subtrees that fit into `size` are one chunk each, leaves merged into their parents;
- where a subtree doesn't fit, its section is a chunk of its own text, together with its first
  subsections while each is smaller than `least` and all fit; the others become chunks below it;
- own text over `size` is split by paragraphs, sentences and cuts, the later pieces below the first.

Chunks are linked both ways: each knows its parent and its children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.functions.profiles import with_rules
from chunkwright.operators.assembly import RULE_COLUMNS, SIZE, bounded_chunks, paragraph_parts
from chunkwright.operators.ordered import stored
from chunkwright.operators.sections import HEADING, sections

#: Subtrees smaller than this are merged into the section above while they fit.
LEAST = 200
ROOT = -1


def tree(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """doc_id, ord, level, parent, kept: all sections and the root of each document, and which begin a chunk."""
    roots = docs.select("doc_id", F.lit(ROOT).cast("long").alias("ord"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("start_char"), F.length("text").cast("long").alias("end_char"), F.lit(None).cast("long").alias("parent"))
    found = sections(docs).select("doc_id", "ord", "level", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), F.coalesce("parent_ord", F.lit(ROOT)).cast("long").alias("parent"))
    nodes = stored(roots.unionByName(found))
    above = nodes.select("doc_id", F.col("ord").alias("parent"), F.col("start_char").alias("from"), (F.col("end_char") - F.col("start_char")).alias("whole"))
    judged = nodes.join(above, ["doc_id", "parent"], "left")
    small = (F.col("end_char") - F.col("start_char") < least) & (F.col("end_char") - F.col("from") <= size)
    siblings = Window.partitionBy("doc_id", "parent").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    kept = (F.col("ord") == ROOT) | ((F.col("whole") > size) & ~F.every(small).over(siblings))
    return judged.select("doc_id", "ord", "level", "parent", kept.alias("kept"))


def hierarchical_chunks(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """doc_id, chunk_index, kind, level, parent_index, children, start_char, content of docs (doc_id, text, lang)."""
    docs = with_rules(docs.where("text IS NOT NULL"))
    docs = stored(docs.select("doc_id", "text", *RULE_COLUMNS))
    kept = stored(tree(docs, size, least).where("kept").drop("kept"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    so_far = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    heads = F.count_if(F.col("line").rlike(HEADING)).over(so_far) - 1
    placed = lines.select("doc_id", "i", "line", heads.alias("ord"), F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("start_char"))
    owned = placed.join(kept.select("doc_id", "ord", F.col("ord").alias("owner")), ["doc_id", "ord"], "left").withColumn("owner", F.coalesce(F.max("owner").over(so_far), F.lit(ROOT)))
    texts = owned.groupBy("doc_id", "owner").agg(F.min("start_char").alias("base"), F.array_join(F.array_sort(F.collect_list(F.struct("i", "line")))["line"], "\n").alias("text"))
    whole = kept.withColumnRenamed("ord", "owner").join(texts, ["doc_id", "owner"], "left").na.fill({"text": "", "base": 0})
    whole = stored(whole.join(docs.select("doc_id", *RULE_COLUMNS), "doc_id"))
    # pieces of what is too long; all others are one piece
    parts = paragraph_parts(whole.where(F.length("text") > size), "owner", "base", *RULE_COLUMNS)
    long_ones = bounded_chunks(parts.withColumn("start_char", F.col("start_char") + F.col("base")), size, "owner")
    pieces = long_ones.unionByName(whole.where(F.length("text") <= size).select("doc_id", "owner", F.col("base").alias("start_char"), F.col("text").alias("content")))
    in_doc = Window.partitionBy("doc_id").orderBy("start_char", "owner")
    own = Window.partitionBy("doc_id", "owner").orderBy("start_char")
    numbered = stored(pieces.withColumns({"chunk_index": (F.row_number().over(in_doc) - 1).cast("long"), "first": F.row_number().over(own) == 1}))
    firsts = numbered.where("first").select("doc_id", F.col("owner").alias("above"), F.col("chunk_index").alias("parent_index"))
    links = numbered.join(kept.select("doc_id", F.col("ord").alias("owner"), "level", "parent"), ["doc_id", "owner"]).withColumn("above", F.when(F.col("first"), F.col("parent")).otherwise(F.col("owner")))
    linked = stored(links.join(firsts, ["doc_id", "above"], "left"))
    below = linked.where("parent_index IS NOT NULL").groupBy("doc_id", F.col("parent_index").alias("chunk_index")).agg(F.array_sort(F.collect_list("chunk_index")).alias("children"))
    kind = F.when(F.col("first") & (F.col("owner") == ROOT), "Root").when(F.col("children").isNotNull(), "Parent").otherwise("Leaf")
    return linked.join(below, ["doc_id", "chunk_index"], "left").select("doc_id", "chunk_index", kind.alias("kind"), "level", "parent_index", F.coalesce("children", F.array().cast("array<long>")).alias("children"), "start_char", "content")
