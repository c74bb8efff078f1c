"""Text refinement as ordered regular-expression steps: one definition, a Column and a DuckDB form.

Patterns are written in the subset that Java and RE2 read alike (no look-around; ASCII classes).
Lines end at \\n alone, as in the rules' definition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


@dataclass(frozen=True)
class Step:
    """Replace every match; groups are written $1. flags: i ignores case, s lets a dot match line ends."""

    pattern: str
    to: str = ""
    flags: str = ""


@dataclass(frozen=True)
class Literal:
    """Replace every occurrence of a plain string."""

    text: str
    to: str = ""


class Trim:
    """Cut blanks from both ends."""


Rule = list


def column(text: Column, rule: Rule) -> Column:
    for step in rule:
        if isinstance(step, Step):
            text = F.regexp_replace(text, f"(?dm{step.flags}){step.pattern}", step.to)
        elif isinstance(step, Literal):
            text = F.replace(text, F.lit(step.text), F.lit(step.to))
        else:
            text = F.btrim(text, F.lit(BLANKS))
    return text


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def duckdb(text: str, rule: Rule) -> str:
    for step in rule:
        if isinstance(step, Step):
            to = re.sub(r"\$(\d)", r"\\\1", step.to)
            text = f"regexp_replace({text}, {quoted(f'(?m{step.flags}){step.pattern}')}, {quoted(to)}, 'g')"
        elif isinstance(step, Literal):
            text = f"replace({text}, {quoted(step.text)}, {quoted(step.to)})"
        else:
            text = f"trim({text}, ' ' || chr(9) || chr(13) || chr(10))"
    return text


_FEW_LINES = Step(r"\n{3,}", "\n\n")
_FEW_BLANKS = Step(r"[ \t]{2,}", " ")
_PARAGRAPH_HEADING = Step(r"^#{1,6}\s*Paragraph\s+\d+\s*$", "", "i")

#: The patterns of each rule.
RULES: dict[str, Rule] = {
    "clean_noise": [_PARAGRAPH_HEADING, _FEW_LINES, _FEW_BLANKS, Trim()],
    "normalize_whitespace": [Step(r"\n\s*\n\s*\n", "\n\n"), Step(r"[ \t]+$"), Trim()],
    "numbered_to_headings": [
        Step(r"^(\d+)\.\s+(.+)$", "## $1. $2"),
        Step(r"^(\d+-\d+)\.\s+(.+)$", "### $1. $2"),
        Step(r"^(\d+-\d+-\d+)\.\s*(\S.*)$", "#### $1. $2"),
        Step(r"^([①②③④⑤⑥⑦⑧⑨⑩])\s+(.+)$", "### $1 $2"),
        Step(r"^\((\d+)\)\s+(.+)$", "### ($1) $2"),
    ],
    "drop_paragraph_headings": [_PARAGRAPH_HEADING, _FEW_LINES, Trim()],
    "drop_image_placeholders": [Step(r"^\[(?:그림|Figure|Image|이미지|사진|도표|표)\].*$", "", "i"), _FEW_LINES, Trim()],
    "drop_contents_leaders": [Step(r"\.{3,}\s*\d+\s*$"), Step(r"-{3,}\s*\d+\s*$"), Step(r"[·•]{3,}\s*\d+\s*$"), Step(r"_{3,}\s*\d+\s*$")],
    "html_to_markdown": [
        Literal("\0"),
        Step(r"</?(?:ol|ul)[^>]*>", "", "i"),
        Step(r"<li[^>]*>\s*(.*?)\s*</li>", "- $1", "is"),
        Step(r"<li[^>]*>\s*([^<]+)", "- $1", "i"),
        Step(r"<br\s*/?>", "\n", "i"),
        Step(r"<p[^>]*>", "\n\n", "i"),
        Step(r"</p>", "\n\n", "i"),
        Step(r"<(?:strong|b)[^>]*>(.*?)</(?:strong|b)>", "**$1**", "is"),
        Step(r"<(?:em|i)[^>]*>(.*?)</(?:em|i)>", "*$1*", "is"),
        Step(r"<code[^>]*>(.*?)</code>", "`$1`", "is"),
        Step(r"""<a\s+[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", "[$2]($1)", "is"),
        Step(r"<[^>]+>"),
        *[
            Literal(a, b)
            for a, b in (
                ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&#39;", "'"), ("&#x27;", "'"),
                ("&mdash;", "—"), ("&ndash;", "–"), ("&bull;", "•"), ("&hellip;", "…"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
            )
        ],
        _FEW_LINES,
        Step(r"\n(#{1,6}\s)", "\n\n$1"),
        Trim(),
    ],
    "strip_embedded_images": [Step(r"!?\[([^\]]*)\]\(data:image/(\w+);base64,([A-Za-z0-9+/\s]+=*)\)", "")],
    "strip_control_characters": [Step(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")],
    "strip_markers": [Step(r"<!--.*?-->", "", "s"), _FEW_LINES, Trim()],
    "bullets_to_markdown": [Step(r"^(\s*)[•●○■□▪▸►→]\s*", "$1- "), Step(r"^\(\d+\)\s+", "1. "), Step(r"^(\s*)[a-z]\)\s+", "$1- ")],
    "image_placeholders_to_markdown": [
        Step(r"<!--\s*IMAGE\s+(IMG_\d+)\s*-->", "![$1](embedded:$1)", "i"),
        Step(r"\[image:\s*([^\]]+)\]", "![$1](embedded:$1)", "i"),
        Step(r"\[(img_\d+)\]", "![$1](embedded:$1)", "i"),
    ],
    "markdown_spacing": [
        Step(r"\r\n", "\n"), _FEW_LINES, Step(r"([^\n])\n(#{1,6}\s)", "$1\n\n$2"), Step(r"(#{1,6}\s[^\n]+)\n([^\n#])", "$1\n\n$2"),
        Step(r"([^\n])\n(```)", "$1\n\n$2"), Step(r"(```)\n([^\n])", "$1\n\n$2"), Trim(),
    ],
    "normalize_line": [
        Step(r"^\s+|\s+$"),
        Step(r"Page\s*\d+", "PAGE_NUM", "i"), Step(r"\d+\s*페이지", "PAGE_NUM"), Step(r"페이지\s*\d+", "PAGE_NUM"), Step(r"第\s*\d+\s*页", "PAGE_NUM"),
        Step(r"Seite\s*\d+", "PAGE_NUM", "i"), Step(r"\b\d+\s*/\s*\d+\b", "PAGE_NUM"),
        Step(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", "DATE"), Step(r"\d{1,2}[-/]\d{1,2}[-/]\d{4}", "DATE"), Step(r"\s+", " "),
    ],
}
