"""Readers: files or binary rows to one row of text, hints and warnings for each document.

Every reader takes rows of (path, content) as Spark's binaryFile source gives them, so files are
listed, split over tasks and re-read after a lost executor by Spark. Formats are parsed with the
standard library; PDF and HWP need native libraries that this package doesn't bring, and give a row
with an error instead of failing the job.
"""

from __future__ import annotations

import csv
import html
import io
import re
import struct
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.sources import markdown

SCHEMA = "path string, reader string, text string, hints map<string,string>, warnings array<string>, errors array<string>"
Parsed = tuple[str, dict[str, str], list[str]]


def decode(data: bytes) -> tuple[str, str]:
    """Text and encoding: byte-order marks first, then strict UTF-8, then CP949."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return data.decode("cp949", "replace"), "cp949"


def read_text(data: bytes, extension: str) -> Parsed:
    text, encoding = decode(data)
    text = text.replace("\0", "")
    hints = {
        "encoding": encoding, "file_type": extension, "line_count": str(text.count("\n") + 1), "character_count": str(len(text)), "word_count": str(len(text.split())),
        "paragraph_count": str(sum(1 for p in text.split("\n\n") if p.strip())),
    }
    if extension == "md":
        hints |= {"header_count": str(len(re.findall(r"(?m)^#{1,6}\s", text))), "code_block_count": str(text.count("```") // 2)}
    return text, hints, ["very short text"] if len(text) < 30 else []


def markdown_table(rows: list[list[str]]) -> str:
    """Rows, the first as header, as a markdown table; short rows are padded, wide ones keep their cells."""
    if not rows:
        return ""
    cell = lambda x: x.replace("|", "\\|").replace("\r\n", "<br>").replace("\n", "<br>").strip()
    width = len(rows[0])
    line = lambda r: "| " + " | ".join(map(cell, [*r, *[""] * (width - len(r))])) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def read_csv(data: bytes, extension: str) -> Parsed:
    text, encoding = decode(data)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter="\t" if extension == "tsv" else ",") if r]
    hints = {"file_type": extension, "encoding": encoding, "row_count": str(max(0, len(rows) - 1)), "column_count": str(len(rows[0]) if rows else 0), "has_tables": str(bool(rows)).lower()}
    return markdown_table(rows), hints, ["decoded as cp949"] if encoding == "cp949" else []


class _Page(HTMLParser):
    """Markdown of an HTML page. Lists nest without repeating their items; tables, links, images and code keep their form."""

    SKIP = {"script", "style", "noscript", "template"}
    BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "aside", "nav", "blockquote", "figure", "figcaption", "body"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title = ""
        self.skip = self.in_title = self.in_pre = 0
        self.lists: list[list] = []
        self.links: list[tuple[str, int]] = []
        self.rows: list[list[str]] | None = None
        self.cell: int | None = None
        self.hints: dict[str, str] = {}
        self.external = self.images = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "title":
            self.in_title = 1
        elif tag == "meta" and (key := a.get("name") or a.get("property")) and (key in ("description", "keywords", "author") or key.startswith("og:")):
            self.hints[key] = a.get("content", "")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            kind, n = self.lists[-1] if self.lists else ("ul", 0)
            self.out.append("\n" + "   " * max(0, len(self.lists) - 1) + (f"{n}. " if kind == "ol" else "- "))
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.cell = len(self.out)
        elif tag == "a":
            self.links.append((a.get("href", ""), len(self.out)))
            self.external += a.get("href", "").startswith("http")
        elif tag == "img":
            self.images += 1
            self.out.append(f"![{a.get('alt', '')}]({a.get('src', '')})")
        elif tag == "pre":
            self.in_pre = 1
            self.out.append("\n\n```\n")
        elif tag == "code" and self.in_pre and (m := re.search(r"language-(\w+)", a.get("class", ""))):
            self.out.append(f"\x00{m[1]}\x00")
        elif tag == "br":
            self.out.append("\n")
        elif tag in self.BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = 0
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag in ("td", "th") and self.rows and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.out[self.cell :]).split()))
            del self.out[self.cell :]
            self.cell = None
        elif tag == "table" and self.rows is not None:
            body = "\n".join(" | ".join(r) for r in self.rows if any(r))
            self.out.append(f"\n\n--- TABLE ---\n{body}\n--- END TABLE ---\n\n")
            self.rows = None
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            label = "".join(self.out[at:])
            del self.out[at:]
            self.out.append(f"[{label}]({href})" if href and label.strip() else label)
        elif tag == "pre":
            self.in_pre = 0
            self.out.append("\n```\n\n")
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.in_title:
            self.title += data
        else:
            self.out.append(data if self.in_pre else re.sub(r"\s+", " ", data))

    def markdown(self) -> str:
        text = re.sub("```\n(.*?)\x00(\\w+)\x00", "```\\2\n\\1", "".join(self.out), flags=re.S).replace("\x00", "")
        text = re.sub(r"[ \t]*\n[ \t]*(?=\n|$)", "\n", text)
        text = re.sub(r"\n{3,}", "\n\n", text).strip()
        return f"# {self.title.strip()}\n\n{text}" if self.title.strip() else text


def read_html(data: bytes, extension: str = "html") -> Parsed:
    page = _Page()
    page.feed(decode(data)[0])
    page.close()
    return page.markdown(), page.hints | {"title": html.unescape(page.title.strip()), "external_links": str(page.external), "images": str(page.images)}, []


def _xml_text(root: ElementTree.Element, leaf: str) -> str:
    return "".join(x.text or "" for x in root.iter() if x.tag.endswith(leaf))


def read_docx(data: bytes, extension: str = "docx") -> Parsed:
    """Paragraphs, with headings by style, and tables."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = next(x for x in root.iter() if x.tag.endswith("}body"))
    out, headings = [], 0
    for block in body:
        if block.tag.endswith("}tbl"):
            out.append(markdown_table([[_xml_text(c, "}t") for c in row if c.tag.endswith("}tc")] for row in block if row.tag.endswith("}tr")]))
            continue
        text = _xml_text(block, "}t").strip()
        style = next((v for x in block.iter() if x.tag.endswith("}pStyle") for k, v in x.attrib.items() if k.endswith("}val")), "")
        if text and (m := re.fullmatch(r"Heading(\d)", style)):
            headings += 1
            text = "#" * min(6, int(m[1])) + " " + text
        if text:
            out.append(text)
    return "\n\n".join(out), {"section_count": str(headings), "has_tables": str(any("| ---" in x for x in out)).lower()}, []


def read_xlsx(data: bytes, extension: str = "xlsx") -> Parsed:
    """A markdown table for each sheet."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = book.namelist()
    shared = [_xml_text(x, "}t") for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [x.attrib["name"] for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if x.tag.endswith("}sheet")]
    out = []
    for title, name in zip(titles, sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))):
        rows = []
        for row in (x for x in ElementTree.fromstring(book.read(name)).iter() if x.tag.endswith("}row")):
            cells: list[str] = []
            for c in row:
                column = 0
                for letter in re.match("[A-Z]*", c.attrib.get("r", ""))[0]:
                    column = column * 26 + ord(letter) - 64
                cells += [""] * (column - 1 - len(cells))
                value = _xml_text(c, "}t") if c.attrib.get("t") == "inlineStr" else _xml_text(c, "}v")
                cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value)
            rows.append(cells)
        while rows and not any(rows[-1]):
            rows.pop()
        out.append(f"## {title}\n\n{markdown_table(rows)}")
    return "\n\n".join(out), {"worksheet_count": str(len(titles)), "worksheets": ",".join(titles), "has_tables": "true"}, []


def read_pptx(data: bytes, extension: str = "pptx") -> Parsed:
    deck = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in deck.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for i, name in enumerate(slides, 1):
        paragraphs = [_xml_text(p, "}t").strip() for p in ElementTree.fromstring(deck.read(name)).iter() if p.tag.endswith("}p")]
        out.append(f"## Slide {i}\n\n" + "\n\n".join(p for p in paragraphs if p))
    return "\n\n".join(out), {"slide_count": str(len(slides))}, []


def read_markdown(data: bytes, extension: str = "md") -> Parsed:
    text, hints, warnings = read_text(data, extension)
    return markdown.to_text(text), hints, warnings


def empty_document_kind(pages: DataFrame) -> DataFrame:
    """doc_id, kind, scanned_pages: no_text_layer where a page shows anything, blank_page where none does. pages: doc_id, texts, images, hidden.

    texts and images count operators; a scan is a page of images without text, or with a hidden layer.
    """
    scan = (F.col("images") > 0) & ((F.col("texts") == 0) | F.col("hidden"))
    seen = F.some(scan) | F.some((F.col("texts") > 0) | (F.col("images") > 0))
    return pages.groupBy("doc_id").agg(F.when(F.coalesce(seen, F.lit(True)), "no_text_layer").otherwise("blank_page").alias("kind"), F.count_if(scan).alias("scanned_pages"))


def unsupported(data: bytes, extension: str) -> Parsed:
    raise ValueError(f"no parser for .{extension} is available here")


#: Readers by extension; `register` replaces or adds one, and the last registered wins.
READERS: dict[str, tuple[str, Callable[[bytes, str], Parsed]]] = {
    **dict.fromkeys(("txt", "tmp", "json"), ("Text", read_text)), **dict.fromkeys(("md", "markdown"), ("Markdown", read_markdown)), **dict.fromkeys(("csv", "tsv"), ("Csv", read_csv)), **dict.fromkeys(("html", "htm"), ("Html", read_html)),
    "docx": ("Word", read_docx), "xlsx": ("Excel", read_xlsx), "pptx": ("PowerPoint", read_pptx), "pdf": ("Pdf", unsupported), "xls": ("LegacyExcel", unsupported), "hwp": ("Hwp", unsupported), "hwpx": ("Hwp", unsupported),
}


def register(extension: str, name: str, reader: Callable[[bytes, str], Parsed]) -> None:
    READERS[extension.lower().lstrip(".")] = (name, reader)


def parse(files: DataFrame) -> DataFrame:
    """Rows of (path, content) as SCHEMA; a file that can't be read is a row with an error."""
    readers = dict(READERS)

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("path", "reader", "text", "hints", "warnings", "errors")}
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                extension = (path or "").rpartition(".")[2].lower()
                name, reader = readers.get(extension, ("Unknown", unsupported))
                text, hints, warnings, errors = None, {}, [], []
                try:
                    text, hints, warnings = reader(data or b"", extension)
                except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                    errors = [f"{type(e).__name__}: {e}"]
                for key, value in (("path", path), ("reader", name), ("text", text), ("hints", list(hints.items())), ("warnings", warnings), ("errors", errors)):
                    out[key].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["path"], pa.string()), pa.array(out["reader"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["hints"], pa.map_(pa.string(), pa.string())), pa.array(out["warnings"], pa.list_(pa.string())), pa.array(out["errors"], pa.list_(pa.string()))],
                names=list(out),
            )

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All files under a path that Spark can list."""
    return parse(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """Format, width and height from the headers of PNG, GIF, BMP, JPEG and WebP images."""
    if data.startswith(b"\x89PNG\r\n\x1a\n") and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("gif", *struct.unpack("<HH", data[6:10]))
    if data.startswith(b"BM") and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "bmp", w, abs(h)
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
        return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if data.startswith(b"\xff\xd8"):
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + length
    return None
