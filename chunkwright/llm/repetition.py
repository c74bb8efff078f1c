"""Quality rules by repetition coverage.

Words become 64-bit ids; prefix sums of ids times powers of an odd base, modulo 2^64, give the hash
of every n-word window as one difference. Windows whose hash comes twice in a text are duplicated,
and the characters of words inside any of them are counted for several n, besides the characters of
lines that repeat an earlier one. A text is kept if neither base rule nor any share is exceeded.

Defined results: null text is empty: no words, base_failed; texts shorter than a window have no
duplicates of it; very long texts are read whole; of equal windows and lines the first counts as the
original, and all are covered where a rule counts what is inside; null or repeated doc_ids and
repeated rows each give a row; an empty table gives no rows; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from chunkwright.llm.common import map_rows

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
REPEAT_WORDS, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Largest percentage of a text's word characters inside duplicated n-word windows, by n, and inside repeated lines.
COVERAGE = {5: 40, 10: 30, 20: 25}
LINE_COVERAGE = 40

_BASE = 0x9E3779B97F4A7C15
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    + "".join(f"dup_chars_{n} long, " for n in COVERAGE)
    + "dup_line_chars long"
)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest text so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.r_[np.uint64(1), np.full(2 * n, _BASE, np.uint64)].cumprod(dtype=np.uint64)
            self.down = np.r_[np.uint64(1), np.full(2 * n, pow(_BASE, -1, 1 << 64), np.uint64)].cumprod(dtype=np.uint64)
        return self.up[:n], self.down[:n]


def duplicated(sums: np.ndarray, down: np.ndarray, n: int) -> np.ndarray | None:
    """Which words stand in an n-word window that comes twice; None if no window does. sums: prefix sums with 0 first."""
    windows = len(sums) - n
    if windows < 2:
        return None
    hashes = (sums[n:] - sums[:-n]) * down[:windows]
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return None
    twice = np.zeros(windows, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(sums), np.int64)
    edges[:windows] += twice
    edges[n : n + windows] -= twice
    return np.cumsum(edges)[:-1] > 0


class Meter:
    """Measures texts; keeps the words it has seen."""

    def __init__(self, most_words: int = 150_000):
        self.powers, self.most = _Powers(), most_words
        self.ids: dict[bytes, int] = {}
        self.hashes, self.chars = np.zeros(1024, np.uint64), np.zeros(1024, np.int64)
        self.rng = np.random.default_rng(2024)

    def _words(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        if len(ids) > self.most:
            ids.clear()
        new = [w for w in dict.fromkeys(words) if w not in ids]
        if new:
            start = len(ids)
            ids.update(zip(new, range(start, start + len(new))))
            if len(ids) > len(self.hashes):
                grow = 2 * len(ids)
                self.hashes, self.chars = np.resize(self.hashes, grow), np.resize(self.chars, grow)
            self.hashes[start : len(ids)] = self.rng.integers(0, 1 << 64, len(new), dtype=np.uint64)
            self.chars[start : len(ids)] = [len(w.decode("utf-8", "surrogatepass")) for w in new]
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def __call__(self, text: str) -> dict:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # bytes split at just the six ASCII white spaces
        n = len(words)
        at = self._words(words)
        chars = self.chars[at]
        total = int(chars.sum())
        seen: set[bytes] = set()
        dup_lines = dup_line_chars = 0
        if b"\n" in raw:
            for line in raw.split(b"\n"):
                if line and not line.isspace():
                    if line in seen:
                        dup_lines += 1
                        dup_line_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in line.split())
                    else:
                        seen.add(line)
        up, down = self.powers(n)
        sums = np.r_[np.uint64(0), np.cumsum(self.hashes[at] * up, dtype=np.uint64)]
        lengths = sorted({REPEAT_WORDS, *COVERAGE})
        inside: dict[int, np.ndarray | None] = {}
        for k in lengths:  # a longer window can only be duplicated where a shorter one is
            inside[k] = None if inside and inside[max(inside)] is None else duplicated(sums, down, k)
        repeat = 0 if inside[REPEAT_WORDS] is None else int(inside[REPEAT_WORDS].sum())
        dup = {k: 0 if inside[k] is None else int(chars[inside[k]].sum()) for k in COVERAGE}
        failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
        kept = not failed and all(100 * dup[k] <= most * total for k, most in COVERAGE.items()) and 100 * dup_line_chars <= LINE_COVERAGE * total
        out = {
            "n_words": n, "word_chars": total, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup_lines, "n_repeat_words": repeat,
            "base_failed": failed, "kept": kept, "dup_line_chars": dup_line_chars,
        }
        return out | {f"dup_chars_{k}": v for k, v in dup.items()}


def measure(docs: DataFrame) -> DataFrame:
    """The columns of SCHEMA for every document."""

    def make() -> Callable:
        meter = Meter()

        def run(rows: dict[str, list]) -> dict[str, list]:
            found = [meter(text or "") for text in rows["text"]]
            names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
            return {"doc_id": rows["doc_id"]} | {name: [x[name] for x in found] for name in names}

        return run

    return map_rows(docs.select("doc_id", "text"), make, SCHEMA)
