"""From refined documents to finished chunks: strategy by content, chunks with offsets, heading paths, pages and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.arrays import kept_by, running_sums
from chunkwright.functions.profiles import sentences as by_language
from chunkwright.functions.profiles import with_rules
from chunkwright.functions.rewrite import RULES, column
from chunkwright.functions.scores import trimmed
from chunkwright.operators.chunking import fixed_windows, sentences
from chunkwright.operators.ordered import stored
from chunkwright.operators.sections import heading_paths, sections

#: Largest chunk, overlap of windows, paragraphs that make a text one of paragraphs, characters of a page.
SIZE, OVERLAP, PARAGRAPHS, PAGE = 1024, 128, 4, 3000
RULE_COLUMNS = ["ends", "abbreviations"]


def auto_strategy(text: Column, size: int = SIZE) -> Column:
    """Sentence for short texts and those of sentences, Paragraph for those of several paragraphs, else Token."""
    full = F.size(F.filter(F.split(text, "\n\n"), lambda p: trimmed(p) != ""))
    return F.when(F.length(text) <= size, "Sentence").when(full >= PARAGRAPHS, "Paragraph").when(F.size(sentences(text)) >= 2, "Sentence").otherwise("Token")


def bounded_chunks(parts: DataFrame, size: int = SIZE, *carried: str) -> DataFrame:
    """doc_id, carried, start_char, content: parts (doc_id, start_char, text and the rules of their language) split until nothing is over size.

    A part that fits stays whole. A larger one is split into sentences, which are joined while they
    fit; a sentence over size is cut every `size` characters. Chunks of a part add up to it, so their
    places follow from their lengths.
    """
    cut = lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    units = F.when(F.length("text") <= size, F.array("text")).otherwise(F.flatten(F.transform(by_language(F.col("text")), cut)))
    split = parts.where("text <> ''").select("doc_id", *carried, "start_char", units.alias("units"))

    def step(a: Column, u: Column) -> tuple:
        joins = a["n"] + F.length(u) <= size
        after = {"i": a["i"] + 1, "at": a["at"] + F.length(u), "n": F.when(joins, a["n"] + F.length(u)).otherwise(F.length(u))}
        return after, ~joins, F.struct(a["i"].alias("i"), a["at"].alias("at"))

    state = {"i": F.lit(0), "at": F.lit(0).cast("long"), "n": F.lit(size + 1)}
    cuts = split.withColumn("cuts", kept_by(F.col("units"), state, step, "struct<i:int,at:bigint>"))
    ends = F.concat(F.slice(F.col("cuts")["i"], 2, F.size("cuts")), F.array(F.size("units")))
    lots = F.zip_with("cuts", ends, lambda c, e: F.struct(c["at"].alias("at"), F.array_join(F.slice("units", c["i"] + 1, e - c["i"]), "").alias("content")))
    return cuts.select("doc_id", *carried, "start_char", F.explode(lots).alias("x")).select("doc_id", *carried, (F.col("start_char") + F.col("x.at")).alias("start_char"), "x.content")


def paragraph_parts(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, start_char, text: what blank lines separate."""
    parts = docs.select("doc_id", *carried, F.split("text", "\n\n").alias("parts"))
    ends = running_sums(F.transform("parts", lambda p: F.length(p) + 2))
    both = parts.select("doc_id", *carried, F.explode(F.zip_with("parts", ends, lambda p, e: F.struct((e - F.length(p) - 2).alias("start_char"), p.alias("text")))).alias("x"))
    return both.select("doc_id", *carried, "x.start_char", "x.text")


def assemble(docs: DataFrame) -> DataFrame:
    """Finished chunks of docs (doc_id, text, lang): doc_id, chunk_index, start_char, end_char, content, strategy, tokens, path, section, page.

    Markers go from the content, blank chunks go, and chunks are numbered by place.
    """
    from pyspark.sql import Window

    docs = stored(docs)  # the refined texts are read by three chunkers and for their sections
    judged = with_rules(docs.where("length(text) > 0").withColumn("strategy", auto_strategy(F.col("text"))))
    of = lambda name: judged.where(F.col("strategy") == name).select("doc_id", F.lit(0).cast("long").alias("start_char"), "text", *RULE_COLUMNS)
    columns = ["doc_id", "start_char", "content", "strategy"]
    every = bounded_chunks(of("Sentence")).withColumn("strategy", F.lit("Sentence")).select(*columns)
    every = every.unionByName(bounded_chunks(paragraph_parts(of("Paragraph"), *RULE_COLUMNS)).withColumn("strategy", F.lit("Paragraph")).select(*columns))
    every = every.unionByName(fixed_windows(of("Token"), SIZE, OVERLAP).withColumn("strategy", F.lit("Token")).select(*columns))
    cleaned = every.withColumn("end_char", F.col("start_char") + F.length("content")).withColumn("content", column(F.col("content"), RULES["strip_markers"])).where("content <> ''")
    numbered = cleaned.withColumn("chunk_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start_char")) - 1).cast("long"))
    paths = heading_paths(numbered.select("doc_id", "chunk_index", "start_char"), sections(docs))
    out = numbered.join(paths, ["doc_id", "chunk_index"])
    return out.select(
        "doc_id", "chunk_index", "start_char", "end_char", "content", "strategy", F.ceil(F.length("content") / 4.0).alias("tokens"), "path", F.element_at(F.split("path", " > "), -1).alias("section"),
        F.expr(f"start_char div {PAGE} + 1").alias("page"),
    )
