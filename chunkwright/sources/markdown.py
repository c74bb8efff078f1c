"""Markdown files as text in which headings, tables, lists and code stand between markers.

Blocks are cut from the lines by what their first line looks like; inline marks are rewritten by one
pattern, code spans first. Link definitions go, links by label get their address, a link without a
label is its address, emphasis is written double, and list items keep their order: nested ones are
indented below theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: What a block's first line looks like, in the order in which it is tried.
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_DEFINITION = re.compile(r"^ {0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s+[\"'(].*[\"')])?\s*$")
_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^(\s*)(?:[-*+]|(\d{1,9})[.)])[ \t]+(.*)$")
_QUOTE = re.compile(r"^ {0,3}> ?")
_DELIMITERS = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_INDENTED = re.compile(r"^(?: {4}|\t)")

_INLINE = re.compile(
    r"(?P<code>(?P<ticks>`+)(?!`).*?(?<!`)(?P=ticks)(?!`))|(?P<escaped>\\[\\`*_{}\[\]()#+.!|<>-])"
    r"|(?P<image>!?)\[(?P<label>(?:[^\[\]]|\[[^\[\]]*\])*)\](?:\(\s*<?(?P<url>[^\s)>]*)>?(?:\s+[\"'][^\"']*[\"'])?\s*\)|\[(?P<ref>[^\]]*)\])?"
    r"|<(?P<auto>[a-z][a-z0-9+.-]*:[^\s>]+)>|(?P<star>\*{1,3})(?=\S)(?P<strong>.+?)(?<=\S)(?P=star)(?!\*)|(?<!\w)(?P<bar>_{1,3})(?=\S)(?P<under>.+?)(?<=\S)(?P=bar)(?!\w)",
    re.S | re.I,
)


def inline(text: str, links: dict[str, str]) -> str:
    def one(m: re.Match) -> str:
        if m["code"]:
            return m["code"]
        if m["escaped"]:
            return m["escaped"][1]
        if m["auto"]:
            return m["auto"]
        if m["star"]:
            return f"**{inline(m['strong'], links)}**"
        if m["bar"]:
            return f"__{inline(m['under'], links)}__"
        label = inline(m["label"], links)
        url = m["url"] if m["url"] is not None else links.get((m["ref"] or m["label"]).lower())
        if url is None:
            return m[0]
        return f"![{label}]({url})" if m["image"] else f"[{label}]({url})" if label else url

    return _INLINE.sub(one, text)


def cells(line: str) -> list[str]:
    bare = line.strip().removeprefix("|")
    bare = bare[:-1] if bare.endswith("|") and not bare.endswith("\\|") else bare
    return [c.strip() for c in re.split(r"(?<!\\)\|", bare)]


def _starts(line: str) -> bool:
    return any(p.match(line) for p in (_FENCE, _HEADING, _RULE, _QUOTE, _ITEM))


def _other_list(first: re.Match, line: str) -> bool:
    """Whether a line begins a list of the other kind beside the first item's."""
    m = _ITEM.match(line)
    return bool(m) and len(m[1]) <= len(first[1]) and bool(m[2]) != bool(first[2])


def _list(lines: list[str], links: dict[str, str]) -> list[str]:
    """A list's lines: bullets, numbers counted anew at each depth, continued lines joined to their item."""
    out: list[str] = []
    depths: list[list[int]] = []  # indent, number reached
    for line in lines:
        m = _ITEM.match(line)
        if not m:
            if line.strip() and out:
                out[-1] += "\n" + inline(line.strip(), links)
            continue
        indent = len(m[1].expandtabs(4))
        while depths and indent < depths[-1][0]:
            depths.pop()
        if not depths or indent > depths[-1][0] + 1:
            depths.append([indent, 0])
        depths[-1][1] += 1
        bullet = f"{depths[-1][1]}. " if m[2] else "• "
        out.append("  " * (len(depths) - 1) + bullet + inline(m[3], links))
    return out


def blocks(text: str, links: dict[str, str]) -> Iterator[list[str]]:
    """The lines of each block as they are written."""
    lines, i = text.split("\n"), 0
    n = len(lines)
    while i < n:
        line = lines[i]
        if not line.strip() or _DEFINITION.match(line):
            i += 1
            continue
        start = i
        if m := _FENCE.match(line):
            i += 1
            while i < n and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[i]):
                i += 1
            yield ["<!-- CODE_START -->", f"```{m[2].strip()}", *lines[start + 1 : i], "```", "<!-- CODE_END -->"]
            i += 1
        elif _INDENTED.match(line):
            while i < n and (_INDENTED.match(lines[i]) or not lines[i].strip()):
                i += 1
            body = "\n".join(_INDENTED.sub("", x) for x in lines[start:i]).rstrip("\n").split("\n")
            yield ["<!-- CODE_START -->", "```", *body, "```", "<!-- CODE_END -->"]
        elif m := _HEADING.match(line):
            level = len(m[1])
            yield [f"<!-- HEADING_START:H{level} -->", f"{m[1]} {inline(m[2] or '', links)}", f"<!-- HEADING_END:H{level} -->"]
            i += 1
        elif _RULE.match(line):
            yield ["---"]
            i += 1
        elif _QUOTE.match(line):
            while i < n and _QUOTE.match(lines[i]):
                i += 1
            inner = "\n".join(_QUOTE.sub("", x) for x in lines[start:i])
            yield [f"> {x}" for block in blocks(inner, links) for x in block if x]
        elif "|" in line and i + 1 < n and "-" in lines[i + 1] and _DELIMITERS.match(lines[i + 1]) and len(cells(lines[i + 1])) == len(cells(line)):
            i += 2
            while i < n and "|" in lines[i] and lines[i].strip():
                i += 1
            rows = [[inline(c, links) for c in cells(x)] for x in (line, *lines[start + 2 : i])]
            written = [f"| {' | '.join(r)} | " for r in rows]
            yield ["<!-- TABLE_START -->", written[0], "|" + "---|" * len(rows[0]), *written[1:], "<!-- TABLE_END -->"]
        elif m := _ITEM.match(line):
            while i < n and not _other_list(m, lines[i]) and (_ITEM.match(lines[i]) or lines[i].strip() and lines[i].startswith(" ") or not lines[i].strip() and i + 1 < n and (_ITEM.match(lines[i + 1]) or re.match(r"^\s+\S", lines[i + 1]))):
                i += 1
            kind = "ORDERED" if m[2] else "UNORDERED"
            yield [f"<!-- LIST_START:{kind} -->", *_list(lines[start:i], links), f"<!-- LIST_END:{kind} -->"]
        else:
            i += 1
            while i < n and lines[i].strip() and not _starts(lines[i]) and not _UNDERLINE.match(lines[i]):
                i += 1
            body = inline("\n".join(x.lstrip() if not x.endswith("  ") else x.strip() + "  " for x in lines[start:i]).rstrip(), links)
            if i < n and (u := _UNDERLINE.match(lines[i])):
                level = 1 if u[1][0] == "=" else 2
                yield [f"<!-- HEADING_START:H{level} -->", f"{'#' * level} {body}", f"<!-- HEADING_END:H{level} -->"]
                i += 1
            else:
                yield body.split("\n")


def to_text(text: str) -> str:
    text = text.replace("\r\n", "\n")
    links = {m[1].lower(): m[2] for m in map(_DEFINITION.match, text.split("\n")) if m}
    return "\n\n".join("\n".join(block) for block in blocks(text, links)).strip()
