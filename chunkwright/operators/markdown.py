"""Markdown from plain lines, tables, blocks and images; and its normalisation with a log of what was done.

Lines are rows where a rule needs its neighbours (fences by a running count, tables as islands of
consecutive lines); rules that carry a level from line to line are folds within the document's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.functions import lines as L
from chunkwright.functions.arrays import kept_by
from chunkwright.functions.rewrite import RULES, column
from chunkwright.functions.scores import trimmed

HEADING = r"^(#{1,6})\s+(.*)$"
ITEM = r"^(\s*)([-*+]|\d+\.)\s+(.*)$"
TABLE_ROW, TABLE_RULE = r"^\s*\|.*\|\s*$", r"^\s*\|[\s:|+-]+\|\s*$"
#: Bullets, and what a table's alignments are written as.
BULLETS = "•●○■□▪▸►→"
ALIGNMENTS = {"left": ":---", "right": "---:", "center": ":---:", "justify": ":---:"}


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, i, line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def joined(rows: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, text of rows doc_id, i, line."""
    return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "line")))["line"], "\n").alias("text"), *carried)


def pipes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def islands(rows: DataFrame, member: Column) -> DataFrame:
    """rows with island: the same number for runs of consecutive member lines, null for others."""
    w = Window.partitionBy("doc_id", "member").orderBy("i")
    return rows.withColumn("member", member).withColumn("island", F.when(F.col("member"), F.col("i") - F.row_number().over(w))).drop("member")


# M01 to M06


def heading(t: Column, least: int = 1, most: int = 6) -> Column:
    """The line as a heading, or null: marked ones with their level clamped, capitals as level 2, section numbers by depth."""
    clamp = lambda n: F.greatest(F.lit(least), F.least(F.lit(most), n))
    marks = lambda n: F.repeat(F.lit("#"), clamp(n))
    title = F.array_join(F.transform(F.split(F.lower(t), " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1000))), " ")
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)", 1)
    return (
        F.when(t.rlike(r"^#{1,6}\s+.+$"), F.concat(marks(F.length(F.regexp_extract(t, "^(#{1,6})", 1))), F.lit(" "), F.regexp_extract(t, r"^#{1,6}\s+(.+)$", 1)))
        .when((F.length(t) <= 100) & t.rlike(r"^[A-Z][A-Z0-9\s_-]+$"), F.concat(marks(F.lit(2)), F.lit(" "), title))
        .when(t.rlike(r"^\d+(?:\.\d+)*\s+[A-Z].+$"), F.concat(marks(F.least(F.lit(6), 2 + F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))))), F.lit(" "), t))
    )


def list_item(line: Column, t: Column) -> Column:
    """The line as a list item, or null: marked ones stay, bullets and letters become -, bracketed numbers stay numbers."""
    indent = F.repeat(F.lit(" "), F.length(line) - F.length(F.ltrim(line)))
    number, rest = F.regexp_extract(t, r"^[(\[]?([0-9]+|[a-zA-Z])[)\].]\s*(.+)$", 1), F.regexp_extract(t, r"^[(\[]?([0-9]+|[a-zA-Z])[)\].]\s*(.+)$", 2)
    return (
        F.when(t.rlike(r"^[-*+]\s+.+") | t.rlike(r"^\d+\.\s+.+"), line)
        .when(t.rlike(f"^[{BULLETS}]\\s*.+$"), F.concat(indent, F.lit("- "), F.regexp_extract(t, f"^[{BULLETS}]\\s*(.+)$", 1)))
        .when(rest != "", F.concat(indent, F.when(number.rlike("^[0-9]"), F.concat(number, F.lit(". "))).otherwise("- "), rest))
    )


def image_line(t: Column) -> Column:
    """The line as an image link, or null."""
    comment, bracket, plain = r"(?i)<!--\s*IMAGE[^>]*IMG_?(\d+)[^>]*-->", r"(?i)\[image:([^\]]+)\]", r"(?i)\[img_?(\d+)\]"
    link = lambda p: F.concat(F.lit("![image](embedded:img_"), F.regexp_extract(t, p, 1), F.lit(")"))
    return (
        F.when(t.rlike(comment), link(comment))
        .when(t.rlike(bracket), F.concat(F.lit("!["), F.regexp_extract(t, bracket, 1), F.lit("](embedded:img_000)")))
        .when(t.contains("embedded:img_"), t)
        .when(t.rlike(plain), link(plain))
    )


def to_markdown(docs: DataFrame) -> DataFrame:
    """doc_id, text: headings, lists, images and tables of plain lines as markdown; fenced code stays."""
    rows = numbered(docs).withColumn("t", trimmed(F.col("line")))
    fence = F.col("t").startswith("```") | F.col("t").startswith("~~~")
    opened = F.sum(fence.cast("int")).over(Window.partitionBy("doc_id").orderBy("i")) % 2 == 1
    rows = rows.withColumn("code", fence | opened)
    rows = islands(rows, ~F.col("code") & (pipes(F.col("t")) >= 2) & ~F.col("t").startswith(">"))
    table = Window.partitionBy("doc_id", "island")
    in_order = table.orderBy("i")
    ruled = F.max(F.col("t").rlike(r"^\|?\s*[-:]+\s*\|")).over(table)
    rows = rows.withColumns({"ruled": ruled, "n": F.count("*").over(table), "place": F.row_number().over(in_order)})
    rule = F.concat(F.lit("\n|"), F.array_join(F.array_repeat(F.lit(" --- "), F.greatest(F.lit(1), pipes(F.col("t")))), "|"), F.lit("|"))
    row = F.concat("t", F.when((F.col("place") == 1) & (F.col("n") > 1) & ~F.col("ruled"), rule).otherwise(""), F.when(F.col("place") == F.col("n"), "\n").otherwise(""))
    t, line = F.col("t"), F.col("line")
    out = F.when(F.col("code"), line).when(F.col("island").isNotNull(), row).otherwise(F.coalesce(heading(t), list_item(line, t), image_line(t), line))
    text = joined(rows.select("doc_id", "i", out.alias("line")))
    return text.select("doc_id", column(F.col("text"), RULES["markdown_spacing"]).alias("text"))


# M07, M09, M10


def cell(text: Column) -> Column:
    return F.trim(F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")))


def table_markdown(cells: Column, has_header: Column, alignments: Column, confidence: Column, doubtful: Column) -> Column:
    """A table of array<array<string>> as markdown; headers are filled up with Col1, Col2, ...; null without columns."""
    width = F.array_max(F.transform(cells, lambda r: F.greatest(F.lit(0), F.size(r))))
    places = F.sequence(F.lit(1), width)
    head = F.when(has_header, cells[0])
    row = lambda values: F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    names = F.transform(places, lambda i: F.when(F.coalesce(F.size(head), F.lit(-1)) >= i, cell(F.get(head, i - 1))).otherwise(F.concat(F.lit("Col"), i.cast("string"))))
    rule = F.transform(places, lambda i: _aligned(F.lower(F.get(alignments, i - 1))))
    data = F.transform(F.slice(cells, F.when(has_header, 2).otherwise(1), F.size(cells)), lambda r: row(F.transform(places, lambda i: cell(F.get(r, i - 1)))))
    note = F.when(doubtful, F.array(F.concat(F.lit("<!-- Table confidence: "), F.format_number(confidence, 2), F.lit(" - may need verification -->")))).otherwise(F.array().cast("array<string>"))
    return F.when(width > 0, F.array_join(F.concat(F.array(row(names), row(rule)), data, note), "\n"))


def _aligned(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, mark in ALIGNMENTS.items():
        out = out.when(name == k, mark)
    return out.otherwise("---")


def block_markdown(kind: Column, content: Column, level: Column, ordered: Column) -> Column:
    """A block of a page as markdown by its kind; null for blank ones. level: of headings and list items."""
    wrap = lambda before, after="": F.concat(F.lit(before), content, F.lit(after))
    marked = (
        F.when(kind == "Heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(1))))), F.lit(" "), content))
        .when(kind == "ListItem", F.concat(F.repeat(F.lit("  "), F.coalesce(level, F.lit(1)) - 1), F.when(ordered, "1. ").otherwise("- "), content))
        .when(kind == "CodeBlock", wrap("```\n", "\n```")).when(kind == "Quote", wrap("> ")).when(kind == "Header", wrap("<!-- Header: ", " -->")).when(kind == "Footer", wrap("<!-- Footer: ", " -->"))
        .when(kind == "Caption", wrap("*", "*")).when(kind == "TocEntry", wrap("- ")).when(kind == "Note", wrap("> **Note:** ")).otherwise(content)
    )
    return F.when(trimmed(content) != "", marked)


def image_markdown(ident: Column, mime: Column, caption: Column, page: Column, width: Column, height: Column) -> Column:
    low = F.lower(mime)
    ext = F.when(low.isin("image/jpeg", "image/jpg"), "jpg").when(low == "image/gif", "gif").when(low == "image/webp", "webp").when(low == "image/svg+xml", "svg").otherwise("png")
    sized = F.concat(F.lit("Image on page "), page.cast("string"), F.lit(" ("), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(")"))
    alt = F.coalesce(F.when(caption != "", caption), F.when((width > 0) & (height > 0), sized), F.concat(F.lit("Image "), ident))
    return F.concat(F.lit("!["), alt, F.lit("](images/"), ident, F.lit("."), ext, F.lit(")"))


def interleaved(items: DataFrame) -> DataFrame:
    """doc_id, text of items doc_id, page, y, ord, markdown: pages in order, each from its top (largest y) down, ties by ord."""
    place = F.struct("page", (-F.col("y")).alias("down"), "ord", "markdown")
    lot = F.array_sort(F.collect_list(F.when(F.col("markdown").isNotNull(), place)))
    return items.groupBy("doc_id").agg(F.array_join(lot["markdown"], "\n\n").alias("text"))


# N01 to N07

ACTION = "struct<stage:int,line:int,kind:string,before:string,after:string>"


def _action(stage: int, i: Column, kind: Column | str, before: Column, after: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(F.lit(stage).alias("stage"), (i + 1).cast("int").alias("line"), kind.alias("kind"), before.alias("before"), after.alias("after"))


def _changed(stage: int, kind: str, before: Column, after: Column) -> Column:
    """Actions of a rule that leaves the number of lines: where they differ."""
    rows = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    return F.array_compact(F.transform(rows, lambda x, i: F.when(x["b"] != x["a"], _action(stage, i, kind, x["b"], x["a"]))))


def _folded(lines: Column, step) -> Column:
    """A fold that rewrites lines with a level carried on: step(level, line) gives (level, line)."""

    def kept(a: Column, x: Column) -> tuple:
        level, line = step(a["level"], x)
        return {"level": level.cast("int")}, F.lit(True), line

    return kept_by(lines, {"level": F.lit(-1)}, kept, "string")


def _heading_step(last: Column, x: Column, first: int = 2, jump: int = 1) -> tuple[Column, Column]:
    own = F.length(F.regexp_extract(x, HEADING, 1))
    level = F.when(last < 0, F.when(own > first, 1).otherwise(own)).otherwise(F.least(own, last + jump))
    new = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.regexp_extract(x, HEADING, 2))
    return F.when(own > 0, level).otherwise(last), F.when((own > 0) & (level != own), new).otherwise(x)


def _item_step(last: Column, x: Column, room: int = 4) -> tuple[Column, Column]:
    item = x.rlike(ITEM)
    own = F.length(F.regexp_extract(x, ITEM, 1))
    deep = item & (last >= 0) & (own > last + room)
    new = F.concat(F.repeat(F.lit(" "), last + 2), F.regexp_extract(x, ITEM, 2), F.lit(" "), F.regexp_extract(x, ITEM, 3))
    return F.when(deep, last + 2).when(item, own).when(trimmed(x) != "", -1).otherwise(last), F.when(deep, new).otherwise(x)


def judged_tables(rows: DataFrame, most_variance: int = 0) -> DataFrame:
    """doc_id, island, first, n, reason (null for a valid table), converted (its text block). rows: doc_id, i, line, island."""
    rows = rows.where("island IS NOT NULL")
    rule = F.col("line").rlike(TABLE_RULE)
    own = F.when(~rule, F.when(pipes(F.col("line")) > 1, pipes(F.col("line")) - 1).otherwise(pipes(F.col("line"))))
    lengths = F.when(~rule, F.transform(F.filter(F.split("line", r"\|"), lambda c: c != ""), lambda c: F.length(trimmed(c))))
    bare = trimmed(F.replace(F.regexp_replace(F.regexp_replace(trimmed(F.col("line")), r"^\|", ""), r"\|$", ""), F.lit("|"), F.lit("\t")))
    t = rows.groupBy("doc_id", "island").agg(
        F.min("i").alias("first"), F.count("*").alias("n"), F.count_if(rule).alias("rules"), F.min(own).alias("least"), F.max(own).alias("most"),
        F.flatten(F.collect_list(lengths)).alias("lengths"), F.array_sort(F.collect_list(F.when(~rule & (bare != ""), F.struct("i", bare.alias("t")))))["t"].alias("bare"),
    )
    mean, longest = F.aggregate("lengths", F.lit(0), lambda a, x: a + x) / F.greatest(F.lit(1), F.size("lengths")), F.coalesce(F.array_max("lengths"), F.lit(0))
    varies = F.concat(F.lit("Column count varies from "), F.col("least").cast("string"), F.lit(" to "), F.col("most").cast("string"), F.lit(" (variance: "), (F.col("most") - F.col("least")).cast("string"), F.lit(f", max allowed: {most_variance})"))
    reason = (
        F.when(F.col("n") < 2, "Table has fewer than 2 rows").when(F.col("least").isNull(), "No data rows in table").when(F.col("most") - F.col("least") > most_variance, varies)
        .when((F.col("rules") == 0) & (F.col("n") > 2), "Complex table structure (missing separator)").when((longest > 5 * mean) & (longest > 100), "Complex table structure (possible merged cells)")
    )
    t = t.withColumn("reason", reason)
    block = F.array_join(F.concat(F.array(F.concat(F.lit("<!-- table: "), "reason", F.lit(" -->")), F.lit("<table>")), F.col("bare"), F.array(F.lit("</table>"))), "\n")
    return t.select("doc_id", "island", "first", "n", "reason", block.alias("converted"))


def normalise(docs: DataFrame) -> DataFrame:
    """doc_id, text, actions, and counters of what was found and done.

    In order: annotations lose their heading marks, empty headings go, heading levels and list indents
    are repaired, tables that aren't regular become text blocks, trailing blanks and more than two blank
    lines in a row go. Actions come by stage and line (as numbered in that stage).
    """
    demoting = L.DEMOTE_ANNOTATIONS.rewrite[0]
    split = docs.select("doc_id", F.split("text", "\n").alias("l0"))
    one = split.withColumn("l1", F.transform("l0", lambda x: F.regexp_replace(x, *demoting)))
    empty = lambda x: trimmed(x).rlike(r"^#{1,6}\s*$")
    gone = F.array_compact(F.transform("l1", lambda x, i: F.when(empty(x), _action(2, i, "EmptyHeadingRemoved", x, F.lit("")))))
    two = one.select("doc_id", "l0", "l1", F.filter("l1", lambda x: ~empty(x)).alias("l2"), gone.alias("a2"))
    three = two.withColumn("l3", _folded(F.col("l2"), _heading_step))
    four = three.withColumn("l4", _folded(F.col("l3"), _item_step))
    promoted = F.array_compact(
        F.transform(
            F.zip_with("l2", "l3", lambda b, a: F.struct(b.alias("b"), a.alias("a"))),
            lambda x, i: F.when(x["b"] != x["a"], _action(3, i, F.when((F.length(F.regexp_extract(x["a"], HEADING, 1)) == 1), "FirstHeadingPromoted").otherwise("HeadingLevelAdjusted"), x["b"], x["a"])),
        )
    )
    acts = F.concat(_changed(1, "AnnotationHeadingDemoted", F.col("l0"), F.col("l1")), "a2", promoted, _changed(4, "ListIndentNormalized", F.col("l3"), F.col("l4")))
    done = four.select("doc_id", F.array_join("l4", "\n").alias("text"), F.size("l0").alias("total_lines"), acts.alias("acts"))
    rows = islands(numbered(done), F.col("line").rlike(TABLE_ROW))
    tables = judged_tables(rows)
    replaced = rows.join(tables.where("reason IS NOT NULL"), ["doc_id", "island"], "left")
    kept = replaced.where(F.col("reason").isNull() | (F.col("i") == F.col("first"))).select("doc_id", "i", F.when(F.col("reason").isNull(), F.col("line")).otherwise(F.col("converted")).alias("line"))
    kind = F.when(F.contains(F.lower("reason"), F.lit("complex")), "ComplexTableConverted").otherwise("MalformedTableConverted")
    counted = tables.groupBy("doc_id").agg(
        F.count("*").alias("found"), F.count("reason").alias("converted"),
        F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), _action(5, F.col("first"), kind, F.concat(F.lit("Table with "), F.col("n").cast("string"), F.lit(" rows")), F.col("reason"))))).alias("a5"),
    )
    stripped = joined(kept).withColumn("text", F.regexp_replace("text", r"(?dm)[ \t\r]+$", ""))
    spaced = stripped.withColumn("after", L.few_blank_lines(F.col("text")))
    blank = F.size(F.split("text", "\n")) - F.size(F.split("after", "\n"))
    n = lambda stage, kind=None: F.size(F.filter("acts", lambda a: (a["stage"] == stage) if kind is None else (a["kind"] == kind)))
    out = done.drop("text").join(spaced.select("doc_id", F.col("after").alias("text"), blank.alias("blank_lines_removed")), "doc_id").join(counted, "doc_id", "left")
    none = F.array().cast(f"array<{ACTION}>")
    last = F.when(F.col("blank_lines_removed") > 0, F.array(_action(6, F.lit(-1), "ExcessiveBlankLinesRemoved", F.col("blank_lines_removed").cast("string"), F.lit("")))).otherwise(none)
    found = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(HEADING)))
    return out.select(
        "doc_id", "text", F.concat("acts", F.coalesce("a5", none), last).alias("actions"), "total_lines", found.alias("headings_found"), n(3).alias("headings_adjusted"), n(2).alias("headings_removed"),
        n(1).alias("headings_demoted"), n(4).alias("list_items_normalized"), "blank_lines_removed", F.coalesce("found", F.lit(0)).alias("tables_found"), F.coalesce("converted", F.lit(0)).alias("tables_converted"),
        (F.coalesce("found", F.lit(0)) - F.coalesce("converted", F.lit(0))).alias("tables_preserved"),
    )


# R17


def refined(docs: DataFrame, structures: tuple[str, str, str], preset: tuple) -> DataFrame:
    """doc_id, digest, n_chars, counts of structures and sections, and the four scores with their mean.

    The whole chain: to_markdown, normalise, structures (patterns of code blocks, tables and lists)
    counted in what is normal, then the preset's rules in order.
    """
    normal = normalise(to_markdown(docs)).select("doc_id", F.col("text").alias("normal"))
    text = F.col("normal")
    for rule in preset:
        text = column(text, rule)
    both = normal.join(docs.select("doc_id", F.length("text").alias("before")), "doc_id").select("doc_id", "normal", "before", text.alias("text"))
    counted = lambda name, pattern: F.size(F.regexp_extract_all(name, F.lit(pattern), F.lit(0))).cast("long")
    code, table, items = structures
    found = both.select(
        "doc_id", "before", F.md5("text").alias("digest"), F.length("text").alias("n_chars"), counted("normal", code).alias("code_blocks"), counted("normal", "(?dm)" + table).alias("tables"), counted("normal", "(?dm)" + items).alias("lists"),
        counted("text", "(?dm)^#{1,6}[ \\t]+[^\\n]+").alias("sections"),
    )
    some, headed = F.col("code_blocks") + F.col("tables") + F.col("lists") > 0, F.col("sections") > 0
    cut, none = 1 - F.col("n_chars") / F.col("before"), F.col("before") == 0
    structure = F.when(some & headed, 0.9).when(some | headed, 0.7).otherwise(0.5)
    cleanup = F.when(none, 1.0).when(cut.between(0.05, 0.2), 0.9).when((cut >= 0) & (cut < 0.05), 0.8).when((cut > 0.2) & (cut <= 0.35), 0.7).otherwise(0.5)
    retention = F.when(none, 1.0).otherwise(F.least(F.lit(1.0), F.col("n_chars") / F.col("before")))
    scored = found.withColumns({"structure": structure, "cleanup": cleanup, "kept": retention, "confidence": F.lit(0.75)})
    mean = (F.col("structure") + F.col("cleanup") + F.col("kept") + F.col("confidence")) / 4
    return scored.select("doc_id", "digest", "n_chars", "code_blocks", "tables", "lists", "sections", "structure", "cleanup", F.round("kept", 9).alias("retention"), "confidence", F.round(mean, 6).alias("overall"))
