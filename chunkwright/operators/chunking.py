"""Chunkers: one document to many chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.arrays import kept_by

#: A mark that texts don't contain; sentence ends are marked with it before splitting.
MARK = "\x01"


def fixed_windows(docs: DataFrame, size: int, overlap: int, *carried: str) -> DataFrame:
    """doc_id, chunk_index, start_char, end_char, content: windows of `size` characters, each sharing `overlap` with the one before.

    The text is cut once into steps; a window is a step and the beginning of the next ones, so a long
    text costs its length, not a walk from its beginning for each window.
    """
    step = size - overlap
    number = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / F.lit(float(step))).cast("int"))
    steps = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    docs = docs.select("doc_id", *carried, number.alias("number"), steps.alias("steps"))
    windows = F.col("steps")
    for k in range(1, 1 + -(-overlap // step)):
        room = F.lit(min(step, overlap - (k - 1) * step))
        ahead = F.concat(F.slice("steps", k + 1, F.greatest(F.lit(0), F.size("steps") - k)), F.array_repeat(F.lit(""), k))
        ahead = F.transform(ahead, lambda x: F.left(x, room))  # noqa: B023 (made at once)
        windows = F.zip_with(windows, ahead, lambda w, x: F.concat(w, F.coalesce(x, F.lit(""))))
    empty = F.when(F.size("steps") == 0, F.array(F.lit(""))).otherwise(F.slice(windows, 1, F.col("number")))
    out = docs.select("doc_id", *carried, F.posexplode(empty).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    start = F.col("chunk_index") * step
    return out.select("doc_id", *carried, "chunk_index", start.alias("start_char"), (start + F.length("content")).alias("end_char"), "content")


def sentences(text: Column) -> Column:
    """Pieces that add up to the text: cut after . ! ? and their wide forms unless a digit or small letter follows (a letter of a script without cases is no small one)."""
    marked = F.regexp_replace(text, "([.!?。！？])", "$1" + MARK)
    joined = F.regexp_replace(marked, MARK + r"(?=\p{Nd}|\p{Ll})", "")
    return F.filter(F.split(joined, MARK), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n\n"), lambda p: p != "")


#: What an oversized sentence is cut to is this much under the bound, and is marked so.
CUT, CUT_MARK = 50, "..."
#: White space at the ends of a chunk.
WHITE = r"\t-\r \x{85}\p{Z}"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def units(text: Column, max_chars: int) -> Column:
    """Array of (p, t): what packing never splits: paragraphs, and sentences of those over max_chars (p: the paragraph's number from 1, else 0)."""
    parts = F.filter(F.split(text, "\r\n\r\n|\n\n"), lambda p: p != "")
    unit = lambda p, t: F.struct(p.cast("int").alias("p"), t.alias("t"))
    return F.flatten(F.transform(parts, lambda part, i: F.when(F.length(part) > max_chars, F.transform(sentences(part), lambda s: unit(i + 1, s))).otherwise(F.array(unit(F.lit(0), part)))))


def pack(docs: DataFrame, max_chars: int = 1600, least: int = 50) -> DataFrame:
    """doc_id, chunk_index, content: units packed greedily up to max_chars, and what is left of `least` characters or fewer dropped.

    Paragraphs are joined by a blank line, sentences of one paragraph as they stand; a sentence over
    max_chars is cut. A fold over the units' lengths finds where a new chunk starts.
    """
    whole = F.length("text") <= max_chars
    read = docs.where("text IS NOT NULL").select("doc_id", "text", F.when(~whole, units(F.col("text"), max_chars)).alias("units"))

    def step(a: Column, u: Column) -> tuple:
        size = F.length(u["t"]) + F.when(u["p"] == 0, 2).otherwise(0)
        joins = (a["p"] == u["p"]) & (a["n"] + size <= max_chars) & (F.length(u["t"]) <= max_chars)
        return {"i": a["i"] + 1, "p": u["p"], "n": F.when(joins, a["n"] + size).otherwise(F.length(u["t"]))}, ~joins, a["i"]

    folded = read.withColumn("starts", kept_by(F.col("units"), {"i": F.lit(0), "p": F.lit(-1), "n": F.lit(0)}, step, "int"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("units")))
    lots = folded.select("doc_id", "text", "units", F.zip_with("starts", ends, lambda a, b: F.slice("units", a + 1, b - a)).alias("lots"))

    def content(lot: Column) -> Column:
        first, every = lot[0], lot["t"]
        cut = F.concat(F.left(first["t"], F.lit(max_chars - CUT)), F.lit(CUT_MARK))
        return trim(F.when(first["p"] == 0, F.array_join(every, "\n\n")).when(F.length(first["t"]) > max_chars, cut).otherwise(F.array_join(every, "")))

    short = F.when(trim(F.col("text")) != "", F.array("text"))
    packed = F.when(F.col("units").isNull(), short).otherwise(F.filter(F.transform("lots", content), lambda c: F.length(c) > least))
    return lots.select("doc_id", F.posexplode(packed).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))
