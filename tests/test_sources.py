"""Readers, sinks, chunkers and the file stream."""

from __future__ import annotations

import io
import random
import re
import struct
import zipfile

from pyspark.sql import functions as F

from chunkwright.functions import models
from chunkwright.operators import chunking, sections
from chunkwright.sources import markdown, readers, sinks
from chunkwright.streaming import files


def test_html_becomes_markdown():
    page = b"""<html><head><title>Doc &amp; more</title><meta name="author" content="A"><style>x</style></head><body><h2>Part</h2><p>One <a href="http://x.y/z">link</a><ul><li>a<ol><li>b</li></ol></li><li>c</li></ul>
    <table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr><tr><td></td><td></td></tr></table><pre><code class="language-python">x = 1
y</code></pre><img src="a.png" alt="pic"></body></html>"""
    text, hints, _ = readers.read_html(page)
    assert text.startswith("# Doc & more\n\n## Part\n\nOne [link](http://x.y/z)")
    assert "- a\n   1. b" in text and text.count("b\n") == 1 and "h | i\n1 | 2\n--- END" in text and "```python\nx = 1\ny\n```" in text and "![pic](a.png)" in text
    assert hints["author"] == "A" and hints["external_links"] == "1"


def test_csv_pads_escapes_and_decodes():
    text, hints, warnings = readers.read_csv("a,b\n1\n\"x|y\",\"l\nm\"\n".encode(), "csv")
    assert text.split("\n") == ["| a | b |", "| --- | --- |", "| 1 |  |", "| x\\|y | l<br>m |"] and hints["row_count"] == "2"
    assert readers.decode("한글".encode("cp949")) == ("한글", "cp949") and readers.decode(b"\xff\xfea\0") == ("a", "utf-16-le") and not warnings


def office(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def test_office_formats():
    w = 'xmlns:w="w"'
    doc = office({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>te</w:t></w:r><w:r><w:t>xt</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert readers.read_docx(doc)[0] == "## Head\n\ntext\n\n| a |\n| --- |"
    x = 'xmlns="m"'
    book = office({
        "xl/workbook.xml": f'<workbook {x}><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {x}><si><t>k</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {x}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row></row></sheetData></worksheet>',
    })
    assert readers.read_xlsx(book)[0] == "## S\n\n| k |  | 5 |\n| --- | --- | --- |"
    deck = office({"ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p:sld>'})
    assert readers.read_pptx(deck)[0] == "## Slide 1\n\nHi"


def test_a_broken_file_is_a_row_with_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r["path"].rpartition("/")[2]: r for r in readers.read(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "hello" and got["a.txt"]["warnings"] and not got["a.txt"]["errors"]
    assert got["b.docx"]["errors"] and got["c.pdf"]["errors"] and got["c.pdf"]["reader"] == "Pdf"


def test_image_headers():
    assert readers.image_size(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 4)) == ("png", 3, 4)
    assert readers.image_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == ("gif", 5, 6)
    assert readers.image_size(b"\xff\xd8\xff\xc0" + struct.pack(">HBHH", 11, 8, 7, 9) + b"\0" * 8) == ("jpeg", 9, 7) and readers.image_size(b"x") is None


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, text string")
    sinks.write_jsonl(rows, str(tmp_path / "j"))
    assert {(r["id"], r["text"]) for r in spark.read.json(str(tmp_path / "j")).collect()} == {(1, "a"), (2, "b"), (3, "a")}
    sinks.write_sharded(rows, "id", str(tmp_path / "s"))
    assert [r["text"] for r in sinks.load_sharded(spark, str(tmp_path / "s"), "2").collect()] == ["b"]
    store = sinks.insert_new(None, rows)
    assert store.count() == 2 and sinks.insert_new(store, spark.createDataFrame([(4, "a"), (5, "z")], "id long, text string")).count() == 1
    assert "id: 1" in sinks.front_matter(rows.where("id = 1"), "text", ["id"]).first()[0]


def packed_by_hand(text: str, most: int, least: int) -> list[str]:
    """Lengths alone decide: every unit goes to the open chunk of its kind if there is room."""
    if len(text) <= most:
        return [text] if text.strip() else []
    every = []
    for i, part in enumerate(p for p in re.split(r"\r\n\r\n|\n\n", text) if p):
        cut = re.split("\x01", re.sub(r"(?<=[.!?。！？])(?=.)", "\x01", part, flags=re.S)) if len(part) > most else [part]
        merged = []
        for piece in cut:  # a digit or small letter goes on with the sentence
            if merged and (piece[:1].isdigit() or piece[:1].islower()):
                merged[-1] += piece
            else:
                merged.append(piece)
        every += [(i if len(part) > most else None, piece) for piece in merged]
    lots: list[list] = []
    for owner, piece in every:
        room = most - sum(len(x) + 2 * (o is None) for o, x in lots[-1]) + 2 * (owner is None) - (2 if owner is None else 0) if lots else -1
        if lots and lots[-1][0][0] == owner and len(piece) <= room and len(piece) <= most:
            lots[-1].append((owner, piece))
        else:
            lots.append([(owner, piece)])
    out = []
    for lot in lots:
        owner, first = lot[0]
        out.append(("\n\n" if owner is None else "").join(x for _, x in lot).strip() if len(first) <= most else first[: most - 50] + "...")
    return [x for x in out if len(x) > least]


def test_packing_covers_and_bounds(spark):
    rng = random.Random(3)
    bits = ["One sentence here. ", "Version 3.5 stands. and goes on. ", "这是中文句子。", "한국어 문장입니다. ", "x" * 300 + "! ", "\n\n", "\n", "Why? ", "é. ", "7. "]
    texts = ["\n\n".join(["One sentence here. " * 20, "x" * 4000, "Short paragraph that is long enough to be kept by the rule."]), "这是中文句子。" * 400, "", "  \n "]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    got: dict = {}
    for r in chunking.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 500, 50).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["content"])
    for i, text in enumerate(texts):
        assert got.get(i, []) == packed_by_hand(text, 500, 50), text
    assert "".join(got[1]) == texts[1] and all(len(c) <= 500 for i in got for c in got[i])


MARKDOWN = """# Title *here*

[ref]: http://x.y/z "t"
A [link](http://a.b/c "t"), a [label][ref], [ref], [](http://bare.url) and ![pic](p.png) with `co*de*` and __bar__ and \\*star\\*.
Second line.

Setext
------

1. one
1. two
   more
   - inner
3. three

- a
- b

| h | i |
|---|:-:|
| 1 | *x* |

> quoted **word**
> next

```python
# no heading
- no list
```

    indented

***
last"""


def test_markdown_becomes_marked_text(spark):
    text = markdown.to_text(MARKDOWN)
    assert text.startswith("<!-- HEADING_START:H1 -->\n# Title **here**\n<!-- HEADING_END:H1 -->\n\nA [link](http://a.b/c), a [label](http://x.y/z), [ref](http://x.y/z), http")
    assert "http://bare.url and ![pic](p.png) with `co*de*` and __bar__ and *star*.\nSecond line." in text and "[ref]:" not in text and "[brackets] stay" in markdown.to_text("[brackets] stay")
    assert "<!-- HEADING_START:H2 -->\n## Setext\n" in text
    assert "<!-- LIST_START:ORDERED -->\n1. one\n2. two\nmore\n  • inner\n3. three\n<!-- LIST_END:ORDERED -->" in text
    assert "<!-- LIST_START:UNORDERED -->\n• a\n• b\n<!-- LIST_END:UNORDERED -->" in text
    assert "<!-- TABLE_START -->\n| h | i | \n|---|---|\n| 1 | **x** | \n<!-- TABLE_END -->" in text
    assert "> quoted **word**\n> next" in text and "<!-- CODE_START -->\n```python\n# no heading\n- no list\n```\n<!-- CODE_END -->" in text
    assert "```\nindented\n```" in text and text.endswith("---\n\nlast")
    assert markdown.to_text("") == "" and markdown.to_text("[a]: b") == ""
    rows = spark.createDataFrame([("x/a.md", MARKDOWN.encode()), ("b.markdown", b"## B"), ("c.md", None)], "path string, content binary")
    got = {r["path"]: r for r in readers.parse(rows).collect()}
    assert got["x/a.md"]["text"] == text and got["x/a.md"]["reader"] == "Markdown" and got["b.markdown"]["text"].count("H2") == 2 and got["c.md"]["text"] == ""


def test_image_hooks(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 4)
    rows = spark.createDataFrame([(png, "a red chart", "the chart is red"), (b"?", "x", None)], "content binary, text string, context string")
    got = rows.select(models.caption(F.col("content")).alias("c"), models.image_relevance(F.col("text"), F.col("context")).alias("r"), models.image_relevance(F.col("text"), F.col("context"), lambda a, b: len(a) / len(b)).alias("f")).collect()
    assert [r["c"] for r in got] == ["png image, 3 by 4 pixels", "unknown image"] and got[0]["r"] == 1.0 and got[0]["f"] == 11 / 16 and got[1]["f"] is None


def test_windows_cover_with_exact_overlap(spark):
    text = "".join(chr(97 + i % 26) for i in range(2500))
    got = [r["content"] for r in chunking.fixed_windows(spark.createDataFrame([(1, text)], "doc_id long, text string"), 1000, 100).orderBy("chunk_index").collect()]
    assert got[0] + "".join(p[100:] for p in got[1:]) == text and all(a[-100:] == b[:100] for a, b in zip(got, got[1:]))


def test_sections_have_parents_and_ends(spark):
    md = "# A\nx\n## B\ny\n### C\n## D\n# E\n"
    got = {r["title"]: r for r in sections.sections(spark.createDataFrame([(1, md)], "doc_id long, text string")).collect()}
    assert got["C"]["parent_ord"] == got["B"]["ord"] and got["D"]["parent_ord"] == got["A"]["ord"] and got["E"]["parent_ord"] is None
    assert got["B"]["end_char"] == got["D"]["start_char"] and got["A"]["end_char"] == got["E"]["start_char"]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}  with   blanks\n\n\n\n" * 80, "en", "s", 1) for i in range(6)], files.DOCUMENTS)
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    files.write_chunks(files.chunk_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    batch = files.refined_chunks(spark.read.parquet(str(tmp_path / "in")))
    (tmp_path / "txt").mkdir()
    for i in range(3):
        (tmp_path / "txt" / f"{i}.txt").write_text(f"line {i}\nnext\n")
    texts = files.write_chunks(files.text_stream(spark, str(tmp_path / "txt")), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    texts.awaitTermination(60)
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out2")).collect()) == [f"line {i}\nnext\n" for i in range(3)]
    rows = lambda frame: sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in frame.select("doc_id", "chunk_index", "content").collect())
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    assert got == rows(batch) and len({r[0] for r in got}) == 6
