"""Boxes on pages: algebra, and spatial joins by grid cells.

A box has an id, a space (columns that must be equal, as document and page), and left, top, right,
bottom. Each box goes to the cells that it covers, and boxes meet in cells; a pair is kept only in
the cell that holds the upper left corner of what the two have in common, so it is made once. A cell
holds what lies in its own part of a page, however many boxes a page has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chunkwright.operators.ordered import stored

SIDES = ["left", "top", "right", "bottom"]
#: Width and height of a cell.
CELL = 128.0


def box(prefix: str = "") -> dict[str, Column]:
    return {s: F.col(prefix + s) for s in SIDES}


def intersects(a: dict, b: dict) -> Column:
    """Strictly: boxes that only touch don't intersect."""
    return (a["left"] < b["right"]) & (a["right"] > b["left"]) & (a["top"] < b["bottom"]) & (a["bottom"] > b["top"])


def contains(a: dict, b: dict) -> Column:
    return (a["left"] <= b["left"]) & (a["right"] >= b["right"]) & (a["top"] <= b["top"]) & (a["bottom"] >= b["bottom"])


def union(a: dict, b: dict) -> dict[str, Column]:
    return {s: (F.least if s in ("left", "top") else F.greatest)(a[s], b[s]) for s in SIDES}


def intersection(a: dict, b: dict) -> dict[str, Column]:
    """What both have in common; with negative sides where they are apart."""
    return {s: (F.greatest if s in ("left", "top") else F.least)(a[s], b[s]) for s in SIDES}


def expand(a: dict, margin: float | Column) -> dict[str, Column]:
    return {s: a[s] - margin if s in ("left", "top") else a[s] + margin for s in SIDES}


def area(a: dict) -> Column:
    return F.greatest(F.lit(0.0), a["right"] - a["left"]) * F.greatest(F.lit(0.0), a["bottom"] - a["top"])


def gap(a: dict, b: dict) -> Column:
    """The distance between two boxes; 0 where they touch or overlap."""
    across = F.greatest(F.lit(0.0), b["left"] - a["right"], a["left"] - b["right"])
    down = F.greatest(F.lit(0.0), b["top"] - a["bottom"], a["top"] - b["bottom"])
    return F.sqrt(across * across + down * down)


def _cells(a: dict, cell: float) -> tuple[Column, Column]:
    at = lambda x: F.floor(x / cell)
    return F.explode(F.sequence(at(a["left"]), at(a["right"]))), F.explode(F.sequence(at(a["top"]), at(a["bottom"])))


def touching(ones: DataFrame, others: DataFrame, space: list[str], cell: float = CELL) -> DataFrame:
    """space, id, other_id and the sides of both (the other's as other_left, ...): pairs of boxes of a space that touch or overlap."""
    across, down = _cells(box(), cell)
    one = ones.select(*space, "id", *SIDES, across.alias("cx")).withColumn("cy", down)
    other = others.select(*space, F.col("id").alias("other_id"), *[F.col(s).alias(f"other_{s}") for s in SIDES])
    across, down = _cells(box("other_"), cell)
    other = other.withColumn("cx", across).withColumn("cy", down)
    met = one.join(other, [*space, "cx", "cy"])
    common = intersection(box(), box("other_"))
    first = (F.floor(common["left"] / cell) == F.col("cx")) & (F.floor(common["top"] / cell) == F.col("cy"))
    return met.where(first & (common["left"] <= common["right"]) & (common["top"] <= common["bottom"])).drop("cx", "cy")


def nearest(ones: DataFrame, others: DataFrame, space: list[str], cell: float = CELL) -> DataFrame:
    """space, id, other_id, distance and the sides of both: for each box the nearest other one of its space, ties by id.

    Boxes are grown by a cell, then by twice as much and so on, until what they touch is known to be
    the nearest: a box at a distance within the margin can't be beaten by one that isn't touched.
    Each round takes up only the boxes that are still open, and none goes beyond the pages' extent.
    """
    spaces = others.select(*space).distinct()
    left = stored(ones.select(*space, "id", *SIDES).join(spaces, space, "left_semi"))
    every = ones.select(*SIDES).unionByName(others.select(*SIDES)).agg(F.max("right") - F.min("left"), F.max("bottom") - F.min("top")).first()  # one row
    margin, extent, found = cell, max((x or 0.0 for x in every), default=0.0), None
    while True:
        grown = left.select(*space, "id", *[c.alias(s) for s, c in expand(box(), F.lit(margin)).items()], F.struct(*SIDES).alias("own"))
        pairs = touching(grown.drop("own"), others, space, max(cell, margin)).drop(*SIDES).join(left, [*space, "id"])
        scored = pairs.withColumn("distance", gap(box(), box("other_")))
        best = scored.groupBy(*space, "id").agg(F.min(F.struct("distance", "other_id", *[f"other_{s}" for s in SIDES])).alias("x")).select(*space, "id", "x.*")
        settled = best.where((F.col("distance") <= margin) | F.lit(margin > extent))
        seen = Observation()
        settled = stored(settled.join(left, [*space, "id"]).observe(seen, F.count("*").alias("n")))
        found = settled if found is None else found.unionByName(settled)
        left = stored(left.join(settled.select(*space, "id"), [*space, "id"], "left_anti"))
        if left.isEmpty() or margin > extent:
            return found
        margin *= 2
