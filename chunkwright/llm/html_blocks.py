"""HTML extraction by line-block distribution.

Markup is stripped to one line for each block element. A line weighs as many characters as it has
outside links, or nothing if more than LINK_SHARE of it are links, if it stands in a menu, header,
footer, sidebar, notice, advert, form, comment section, script or style, or outside the page's
article (where it marks one). The sums of weights over WINDOW lines rise from zero at surge points
and return to it at dive points; the text is what stands between a surge and its dive. So a line that
is all links is text if text stands close to it, also in an article, while WINDOW such lines in a row
let the sum fall to zero and are a menu, wherever they stand and whatever their names. On pages that
mark no article, stretches whose peak and whose heaviest line are both under PEAK_SHARE of the main
stretch's are left out, unless they stand in its container (other than the page itself), or between
its heading and the last stretch that is kept.

Defined results: null or empty html gives an empty text; null urls and page_ids stay null; repeated
rows each give a row; very long pages are read whole, in time linear in their length; of stretches
with equal peaks the first is the main one; unclosed and stray tags are tolerated; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from chunkwright.llm.common import map_rows

WINDOW = 3
PEAK_SHARE = 0.25
LINK_SHARE = 0.6

#: Element names by role.
RAW = "script style noscript template textarea select svg iframe object canvas math audio video".split()
OUT = "head title nav footer aside form menu dialog button label fieldset".split()
ROOT = "article main".split()
BLOCK = (
    "html body head title p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption thead tbody tfoot tr td th section article main header footer "
    "aside nav blockquote pre figure figcaption form fieldset hr address details summary menu dialog center option"
).split()
CONTAINER = "div section td center".split()
HEADING = "h1 h2 h3 h4 h5 h6".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Words of class, id and role names that mark what isn't the article: menus, headers, footers, sidebars, notices, adverts, forms, reader comments.
OUT_NAMES = (
    "menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar skip masthead footer contentinfo sidebar sidebars widget widgets complementary "
    "cookie cookies consent gdpr notice notices alert popup modal overlay ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "newsletter subscribe subscription login signup signin comment comments commentlist disqus reply replies respond"
).split()
OUTER_NAMES = "header topbar banner".split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\s(?:"[^"]*"|'[^']*'|[^"'>])*+|/)?)>|</?[a-zA-Z][^>]*>""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_OUT, _ROOT, _BLOCK, _VOID = set(OUT), set(ROOT), set(BLOCK), set(VOID)
_OUT_NAMES, _OUTER_NAMES = set(OUT_NAMES), set(OUTER_NAMES)


def _out(name: str, rest: str, in_root: bool) -> bool:
    if name in _OUT or name == "header" and not in_root:
        return True
    if not rest or name in ("html", "body") or name in _ROOT:
        return False
    words = {w for m in _NAMES.finditer(rest) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}
    return not words.isdisjoint(_OUT_NAMES) or not in_root and not words.isdisjoint(_OUTER_NAMES)


def lines(page: str) -> tuple[list[tuple[str, bool, bool, int, int, int]], bool, list[int]]:
    """(text, left out, in the article, characters of links, heading level or 0, container) for each block with text, whether an article is marked, and each container's outer one (0: the page)."""
    found: list[tuple[str, bool, bool, int, int, int]] = []
    outer = [0]
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, int, int, bool]] = []  # name, left out, in the article, heading level, container, in a link
    out = root = marked = False
    links = anchor = level = container = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append((text, out, root, links, level, container))
            parts.clear()
        links = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if anchor:
                links += m.start() - at
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        block = name in _BLOCK
        if block:
            flush()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in _ROOT and name not in ("body", "html"):
                    break  # a stray end tag doesn't end the article
        elif name not in _VOID and not m["rest"].endswith("/"):
            if block:
                while stack and stack[-1][0] not in _BLOCK:  # unclosed inline elements
                    stack.pop()
                if stack and (stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li"):
                    stack.pop()
            up_out, up_root, up_level, up_container, up_anchor = stack[-1][1:] if stack else (False, False, 0, 0, False)
            inside = up_root or name in _ROOT and not up_out
            if name in CONTAINER:
                outer.append(up_container)
                up_container = len(outer) - 1
            stack.append((name, up_out or _out(name, m["rest"], inside), inside, int(name[1]) if name in HEADING else up_level, up_container, name == "a" or up_anchor))
            marked = marked or name in _ROOT and not up_out
        out, root, level, container, anchor = stack[-1][1:] if stack else (False, False, 0, 0, False)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return found, marked, outer


def _kept(found: list, weights: list[int], stretches: list[tuple[int, int, int]], outer: list[int], peak_share: float) -> list[tuple[int, int, int]]:
    """The stretches of a page without article that belong to its text."""
    lots = [[i for i in range(surge, dive) if weights[i]] for surge, dive, _ in stretches]
    heaviest = [max(weights[i] for i in lot) for lot in lots]
    top = max(range(len(stretches)), key=lambda k: stretches[k][2])
    keep = [peak >= peak_share * stretches[top][2] or heavy >= peak_share * heaviest[top] for (*_, peak), heavy in zip(stretches, heaviest)]
    places = {found[i][5] for i in lots[top]}
    home = places.pop()
    for c in places:  # a container's number is higher than its outer one's
        while c != home:
            c, home = (outer[c], home) if c > home else (c, outer[home])
    inside = [False] * len(outer)
    for c in range(1, len(outer)):
        inside[c] = home > 0 and (c == home or inside[outer[c]])
    keep = [kept or any(inside[found[i][5]] for i in lot) for kept, lot in zip(keep, lots)]
    heads = [(found[i][4], -k) for k in range(top + 1) for i in lots[k] if found[i][4]]
    start = min(keep.index(True), -min(heads)[1] if heads else top)
    last = len(keep) - 1 - keep[::-1].index(True)
    return stretches[start : last + 1]


def weigh(found: list, marked: bool) -> list[int]:
    """The weight of each line."""
    return [0 if out or marked and not root or links > LINK_SHARE * len(text) else len(text) - min(links, len(text) - 1) for text, out, root, links, *_ in found]


def stretches_of(weights: list[int], window: int) -> list[tuple[int, int, int]]:
    """Surge, dive and peak of each stretch of lines over which the window's sum isn't zero."""
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    sums = [total[min(len(weights), i + window)] - total[i] for i in range(len(weights))]
    found = []
    i = 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        surge = i
        while i < len(sums) and sums[i]:
            i += 1
        found.append((surge, i, max(sums[surge:i])))
    return found


def main_text(page: str | None, window: int = WINDOW, peak_share: float = PEAK_SHARE) -> str:
    """The text between surge and dive points."""
    found, marked, outer = lines(page or "")
    weights = weigh(found, marked)
    stretches = stretches_of(weights, window)
    if stretches and not marked:
        stretches = _kept(found, weights, stretches, outer, peak_share)
    # lines of links between a surge and its dive; at the edges of a stretch only where the article's mark says that they belong to it
    shown: list[str] = []
    for k, (surge, dive, _) in enumerate(stretches):
        heavy = [i for i in range(surge, dive) if weights[i]]
        first, last = heavy[0], heavy[-1]
        if marked:
            before = stretches[k - 1][1] if k else 0
            after = stretches[k + 1][0] if k + 1 < len(stretches) else len(found)
            while first > before and first > surge and _linked(found[first - 1]):
                first -= 1
            if first > before and _linked(found[first - 1]):
                first = heavy[0]  # the end of a longer row of links
            ahead = last + 1
            while ahead < after and _linked(found[ahead]):
                ahead += 1
            if ahead - last <= window - 1:
                last = ahead - 1
        shown += [found[i][0] for i in range(first, last + 1) if weights[i] or not found[i][1] and (found[i][2] or not marked)]
    return "\n\n".join(shown)


def _linked(line: tuple) -> bool:
    """Whether a line of the article is links."""
    text, out, root, links, *_ = line
    return root and not out and links > LINK_SHARE * len(text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def make() -> Callable:
        def run(rows: dict[str, list]) -> dict[str, list]:
            texts = [main_text(page) for page in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return run

    return map_rows(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")
