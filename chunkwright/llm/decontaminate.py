"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units are replaced by typed placeholders. Windows of
WINDOW template tokens are hashed and joined between documents and benchmark items. The windows that
a text shares with an item are then laid over each other: a leak needs enough of the item, and its
slots must be filled consistently, each value of the item standing for one value of the document and
the other way round. An item under WINDOW words is one window of its own length, and windows of that
length are taken from the documents too. Each diagonal (a way to lay the text over the item) is judged
on its own, so that an item that resembles itself further on doesn't clash with its own copy. Windows
are gathered by text, item and block of diagonals; blocks overlap by what one instance can span, so
what is gathered in a row is bounded by the item's length, however long the text and however often it
repeats the item.

The benchmark's window hashes go to the workers only up to MAX_SHARED of them; a larger benchmark is
met by a shuffle join over all windows of the documents instead, with the same result.

Defined results: null texts are empty and match nothing; very long texts are read whole; items of no
windows (too few words that aren't placeholders) match nothing; of equally good instances the one with
slots filled as in the item counts; null or repeated doc_ids and repeated rows each give their rows; a
null item_id is an id like any other, and equal items with ids of their own are all found; an empty
table on either side gives no rows; extra columns are ignored, whatever their names. A document is
cleaned away by its text, so its doc_id may be null or shared.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import map_rows, materialize, mix, shingle_hashes, text_of

WINDOW = 8
#: Words that aren't placeholders which a window needs.
LEAST_PLAIN = 4
#: A leak covers this share of an item's words, or a run of this many words.
COVERAGE, RUN = 0.5, 20
#: Window hashes that are sent to workers (8 bytes each).
MAX_SHARED = 2_000_000
#: Windows that start on diagonals this close can belong to one instance.
SLACK = WINDOW

#: Units of measure.
UNITS = (
    "mm cm dm m km mg g kg t ml cl l s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres dollar dollars cent cents euro euros percent degree degrees mph kmh kph hz khz mhz ghz w kw v a"
).split()
SIGNS = "%$€£°"

_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*|[.!?;:\n|" + SIGNS + "]")
_PLAIN, _CAPITAL, _NUMBER, _UNIT, _SIGN, _END = range(6)
#: A token's hash and its kind in one number: the kind takes the lowest bits.
_KIND_BITS = np.uint64(7)
_HASH_BITS = 2**64 - 8
_HOLDERS = {"number": xxhash.xxh3_64_intdigest("<number>"), "name": xxhash.xxh3_64_intdigest("<name>"), "unit": xxhash.xxh3_64_intdigest("<unit>")}


class Templates(dict):
    """Template tokens of texts. As a dict it keeps the hash and kind of the tokens it has met."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most
        self.units = set(UNITS)

    def _kind(self, token: str, word: str) -> int:
        if token[0].isdigit():
            return _NUMBER
        if token in SIGNS:
            return _SIGN
        if not token[0].isalpha():
            return _END
        if word in self.units:
            return _UNIT
        return _CAPITAL if token[0].isupper() and not token.isupper() else _PLAIN  # words all in capitals are set so, not names

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        if token.islower():
            word, kind = token, _UNIT if token in self.units else _PLAIN
        else:
            word = token.lower()
            kind = self._kind(token, word)
        found = self[token] = xxhash.xxh3_64_intdigest(word) & _HASH_BITS | kind
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, Callable[[int], str]]:
        """Template hashes, where they are placeholders, and the word at a place."""
        tokens = _TOKEN.findall(text)
        hashes = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        kinds = (hashes & _KIND_BITS).astype(np.int8)
        hashes |= _KIND_BITS  # the kind is no part of a word's hash
        before = np.r_[np.int8(_END), kinds[:-1]] if len(kinds) else kinds
        number = kinds == _NUMBER
        unit = (kinds == _SIGN) | (kinds == _UNIT) & (before == _NUMBER)
        name = (kinds == _CAPITAL) & (before != _END)
        for where, holder in ((number, "number"), (unit, "unit"), (name, "name")):
            hashes[where] = np.uint64(_HOLDERS[holder])
        kept = np.flatnonzero(kinds != _END)
        return hashes[kept], (number | unit | name)[kept], lambda i: tokens[kept[i]].lower()


def windows(hashes: np.ndarray, slots: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that have enough plain words; a shorter text is one window of its own length."""
    n = min(size, len(hashes))
    if n < LEAST_PLAIN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    plain = np.r_[0, np.cumsum(~slots)]
    starts = np.flatnonzero(plain[n:] - plain[:-n] >= LEAST_PLAIN)
    return starts, mix(shingle_hashes(hashes, n)[starts] + np.uint64(n))


def text_key() -> Column:
    return F.unhex(F.md5(text_of()))


WINDOWS = "array<struct<at:int,hash:bigint,slots:array<string>>>"


def _windows_of(table: DataFrame, key: str, shared=None, sizes: tuple[int, ...] = ()) -> DataFrame:
    """key, text key, number of template words, windows (those among the shared hashes, if given), and windows of further sizes below WINDOW."""

    def make() -> Callable:
        templates = Templates()
        known = None if shared is None else shared.value

        def run(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {key: rows[key], "text_key": rows["text_key"], "n": [], "windows": []}
            for text in rows["text"]:
                hashes, slots, word = templates(text)
                every = []
                for size in [WINDOW, *(size for size in sizes if size < len(hashes))]:
                    starts, found = windows(hashes, slots, size)
                    if known is not None and len(found):
                        i = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
                        hit = known[i] == found if len(known) else np.zeros(len(found), bool)
                        starts, found = starts[hit], found[hit]
                    every += [{"at": int(s), "hash": int(h), "slots": [word(int(j)) for j in np.flatnonzero(slots[s : s + size]) + s]} for s, h in zip(starts, found.view(np.int64))]
                out["n"].append(len(hashes))
                out["windows"].append(every)
            return out

        return run

    read = table.select(F.col(key).cast("long").alias(key), text_key().alias("text_key"), text_of().alias("text"))
    return map_rows(read, make, f"{key} long, text_key binary, n int, windows {WINDOWS}")


def _filled(pairs: list[dict], one: dict, back: dict) -> bool:
    """Whether the pairs fill slots one to one, and as one and back do; if so, both are extended."""
    more, rest = dict(one), dict(back)
    for p in pairs:
        for a, b in zip(p["item_slots"], p["slots"]):
            if more.setdefault(a, b) != b or rest.setdefault(b, a) != a:
                return False
    one.update(more)
    back.update(rest)
    return True


def _chain(seed: tuple[int, list[dict]], units: list[tuple[int, list[dict]]]) -> list[dict]:
    """The seed with what fits of units on near diagonals: windows increase in the text and in the item, and slots agree."""
    one, back = {}, {}
    _filled(seed[1], one, back)
    chain, low, high = list(seed[1]), seed[0], seed[0]
    grown = len(units) > 1
    while grown:
        grown = False
        for diagonal, lot in units:
            if not low - SLACK <= diagonal <= high + SLACK:
                continue
            places = [p["at"] for p in chain]
            fits = []
            for p in lot:
                i = bisect_left(places, p["at"])
                if i < len(chain) and (chain[i]["at"] == p["at"] or chain[i]["item_at"] <= p["item_at"]) or i and chain[i - 1]["item_at"] >= p["item_at"]:
                    continue
                if any(abs(c["at"] - c["item_at"] - diagonal) <= SLACK for c in chain[max(0, i - 1) : i + 1]):
                    fits.append(p)
            if fits and _filled(fits, one, back):
                chain = sorted(chain + fits, key=lambda p: p["at"])
                low, high, grown = min(low, diagonal), max(high, diagonal), True
    return chain


def _best(n: int, pairs: list[dict]) -> tuple[bool, int, int, bool] | None:
    """Of the best consistent instance: whether it is a leak, words covered, longest run, whether slots are filled anew.

    A diagonal is one way to lay a text over an item, and its slots are judged on their own; where they
    clash, its verbatim windows are left. Diagonals within SLACK are chained around each of them.
    """
    diagonals: dict[int, list[dict]] = {}
    for p in sorted(pairs, key=lambda p: p["at"]):
        diagonals.setdefault(p["at"] - p["item_at"], []).append(p)
    units = []
    for diagonal, lot in sorted(diagonals.items()):
        if not _filled(lot, {}, {}):
            lot = [p for p in lot if p["slots"] == p["item_slots"]]
        if lot:
            units.append((diagonal, lot))
    best, start = None, 0
    for end in range(1, len(units) + 1):
        if end < len(units) and units[end][0] - units[end - 1][0] <= SLACK:
            continue
        places = [diagonal for diagonal, _ in units[start:end]]
        for seed in sorted(units[start:end], key=lambda u: -len(u[1])):
            # a chain of rising windows moves by less than the item's length and SLACK for each of them
            reach = SLACK * n
            near = units[start + bisect_left(places, seed[0] - reach) : start + bisect_right(places, seed[0] + reach)]
            covered, anew = np.zeros(n + WINDOW, np.int8), False
            for p in _chain(seed, sorted(near, key=lambda u: -len(u[1]))):
                covered[p["item_at"] : min(n, p["item_at"] + WINDOW)] = 1
                anew = anew or p["slots"] != p["item_slots"]
            edges = np.flatnonzero(np.diff(np.r_[0, covered, 0]))
            words, run = int(covered.sum()), int((edges[1::2] - edges[::2]).max(initial=0))
            found = (words >= COVERAGE * n or run >= RUN, words, run, not anew)
            best = found if best is None else max(best, found)
            if best[1] == n and best[3]:
                return (*best[:3], False)
        start = end
    return best and (*best[:3], not best[3])


def leaking_texts(docs: DataFrame, benchmark: DataFrame, max_shared: int = MAX_SHARED) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key of the documents that share windows; text_key, item_id, covered, run, reparameterised of every leak."""
    spark = docs.sparkSession
    items = materialize(_windows_of(benchmark, "item_id"))
    item_windows = items.select("item_id", F.col("n").alias("item_n"), F.explode("windows").alias("w")).select("item_id", "item_n", F.col("w.at").alias("item_at"), F.col("w.hash").alias("hash"), F.col("w.slots").alias("item_slots"))
    shared = None
    if item_windows.count() <= max_shared:
        known = np.array([r[0] for r in item_windows.select("hash").distinct().collect()], np.int64).view(np.uint64)
        shared = spark.sparkContext.broadcast(np.sort(known))
    sizes = tuple(sorted(r[0] for r in items.where(f"n < {WINDOW} AND size(windows) > 0").select("n").distinct().collect()))  # of 4 to 7
    found = materialize(_windows_of(docs, "doc_id", shared, sizes)).where("size(windows) > 0")
    texts = found.groupBy("text_key").agg(F.first("windows").alias("windows"))
    pairs = texts.select("text_key", F.explode("windows").alias("w")).select("text_key", F.col("w.at").alias("at"), F.col("w.hash").alias("hash"), F.col("w.slots").alias("slots")).join(item_windows, "hash")
    # an instance reaches SLACK * item_n diagonals from its seed: each diagonal has that room in one of its two blocks of four times as many
    block = F.expr(f"floor((at - item_at) / (2 * {SLACK} * item_n))")
    pairs = pairs.withColumn("block", F.explode(F.array(block, block - 1)))
    laid = pairs.groupBy("text_key", "item_id", "item_n", "block").agg(F.collect_list(F.struct("at", "item_at", "slots", "item_slots")).alias("pairs"))

    def make() -> Callable:
        def run(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"text_key": [], "item_id": [], "covered": [], "run": [], "verbatim": []}
            for key, item_id, n, lot in zip(rows["text_key"], rows["item_id"], rows["item_n"], rows["pairs"]):
                leak, covered, run_length, anew = _best(n, lot) or (False, 0, 0, False)
                if leak:
                    for name, value in (("text_key", key), ("item_id", item_id), ("covered", covered / n), ("run", run_length), ("verbatim", not anew)):
                        out[name].append(value)
            return out

        return run

    judged = map_rows(laid, make, "text_key binary, item_id long, covered double, run int, verbatim boolean")
    best = judged.groupBy("text_key", "item_id").agg(F.max(F.struct("covered", "run", "verbatim")).alias("best"))
    return found.select("doc_id", "text_key"), best.select("text_key", "item_id", "best.covered", "best.run", (~F.col("best.verbatim")).alias("reparameterised"))


def leaks(docs: DataFrame, benchmark: DataFrame, max_shared: int = MAX_SHARED) -> DataFrame:
    """doc_id, item_id, covered (share of the item's words), run (words), reparameterised, for every leak."""
    found, leaking = leaking_texts(docs, benchmark, max_shared)
    return found.join(materialize(leaking), "text_key").select("doc_id", "item_id", "covered", "run", "reparameterised")  # written first, so that a frequent text's partition can be split


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents whose texts hold no leak."""
    leaking = materialize(leaking_texts(docs, benchmark)[1].select("text_key").distinct())
    return docs.select(F.struct("*").alias("row"), text_key().alias("text_key")).join(leaking, "text_key", "left_anti").select("row.*")
