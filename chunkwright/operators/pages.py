"""Headers and footers: lines that repeat over a document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.rewrite import RULES, column


def numbered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pages, i, line, norm (the line with page numbers and dates made equal)."""
    return docs.select("doc_id", "pages", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("norm", column(F.col("line"), RULES["normalize_line"]))


def drop_repeated_lines(docs: DataFrame, threshold: float = 0.5, max_length: int = 200, least_pages: int = 3, preserve: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """doc_id, text without lines whose normal form comes on at least that share of the pages (two at least); shorter documents stay.

    The rule looks at one document, so it works within the row: among sorted normal forms, one comes k
    times if the form k - 1 places on is the same.
    """
    split = docs.select("doc_id", "pages", "text", F.split("text", "\n").alias("lines"))
    normal = split.withColumn("norms", F.transform("lines", lambda x: column(x, RULES["normalize_line"])))
    eligible = F.filter(F.arrays_zip("lines", "norms"), lambda x: (F.length(x["lines"]) <= max_length) & (x["norms"] != ""))
    times = F.greatest(F.lit(2), F.floor(F.col("pages") * threshold)).cast("int")
    ordered = normal.select("doc_id", "pages", "text", "lines", "norms", times.alias("times"), F.array_sort(eligible["norms"]).alias("ordered"))
    frequent = F.array_distinct(F.filter("ordered", lambda x, i: F.get("ordered", i + F.col("times") - 1) == x))
    if preserve:
        frequent = F.filter(frequent, lambda x: ~F.rlike(x, F.lit("(?i)" + "|".join(f"(?:{p})" for p in preserve))))
    kept = ordered.withColumn("frequent", frequent)

    def stays(x: Column) -> Column:
        out = (x["norms"] == "") | ~F.array_contains("frequent", x["norms"])
        if remove:
            out = out & ((x["norms"] == "") | ~F.rlike(x["lines"], F.lit("(?i)" + "|".join(f"(?:{p})" for p in remove))))
        return out

    text = F.array_join(F.filter(F.arrays_zip("lines", "norms"), stays)["lines"], "\n")
    return kept.select("doc_id", F.when(F.col("pages") < least_pages, F.col("text")).otherwise(text).alias("text"))


def repeated_line_report(docs: DataFrame, threshold: float = 0.5, max_length: int = 200) -> DataFrame:
    """doc_id, norm, occurrences, ratio, would_be_filtered of lines that come twice or more."""
    lines = numbered_lines(docs).where((F.length("line") <= max_length) & (F.col("norm") != ""))
    counted = lines.groupBy("doc_id", "norm").agg(F.count("*").alias("occurrences"), F.max("pages").alias("pages")).where("occurrences >= 2")
    ratio = F.col("occurrences") / F.col("pages")
    return counted.select("doc_id", "norm", "occurrences", F.round(ratio, 6).alias("ratio"), (ratio >= threshold).alias("would_be_filtered"))
