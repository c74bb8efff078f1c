"""Packing by cutting-stock column generation.

A document's token ids, and id 0 after them, are cut into pieces of `capacity` tokens and a rest.
The histogram of lengths, in classes of WIDTH tokens, is a cutting-stock problem: its linear program
starts with one pattern for each class, a knapsack dynamic program prices better patterns until none
is left, and the patterns' numbers are rounded down. The few pieces left over are packed best-fit.
Pieces are ranked within their class and a pattern's repetitions take consecutive ranks, so the plan
is a small table of rank intervals whose size depends on the classes and not on the corpus.

Defined results: null text is empty and gives one piece of one token; very long texts are cut into as
many pieces as they need; null or repeated doc_ids and repeated rows are packed as rows of their own;
ties in the order are equal in all columns but do get places of their own; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.llm.common import local_prefix, map_rows, materialize

CAPACITY = 1024
WIDTH = 8
#: Bound on simplex steps; a program stopped there is a valid plan, only less tight.
MAX_STEPS = 4000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_END = "<|endoftext|>"
#: tiktoken's expression runs out of stack on a million blanks in a row; the look-behind keeps the search linear.
_MOST_BLANKS = 900_000
_BLANKS = re.compile(rf"(?<!\s)\s{{{_MOST_BLANKS}}}")


class Tokens:
    """Ids of a text as little-endian 32-bit bytes, the same as the tokenizer file gives; a text is one call, whatever its words."""

    def __init__(self, path: str, ranks_path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _END in text or len(text) >= _MOST_BLANKS and _BLANKS.search(text):  # a special token, which only the tokenizer itself knows, or too many blanks
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return array("I", self.plain(text)).tobytes()


_LOADED: dict[str, Tokens] = {}


def _tokens(path: str | None) -> Tokens:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _LOADED:
        _LOADED[path] = Tokens(path, path.removesuffix(".json") + ".tiktoken")
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, each with the checksum of its ids."""

    def make() -> Callable:
        tokens = _tokens(tokenizer)

        def run(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                ids = tokens(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    end = min(n, at + capacity)
                    for name, value in (("doc_id", doc_id), ("start", at), ("length", end - at), ("ids_crc32", zlib.crc32(ids[4 * at : 4 * end])), ("doc_tokens", n)):
                        out[name].append(value)
            return out

        return run

    return map_rows(docs.select("doc_id", "text"), make, PIECES)


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most value that fits, each item any number of times, and how often each is taken."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        best[w], took[w] = best[w - 1], -1
        fits = np.searchsorted(sizes, w, side="right")
        if fits:
            gains = values[:fits] + best[w - sizes[:fits]]
            i = int(np.argmax(gains))
            if gains[i] > best[w] + 1e-12:
                best[w], took[w] = gains[i], i
    counts, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            counts[took[w]] += 1
            w -= sizes[took[w]]
    return float(best[room]), counts


def generate_columns(sizes: np.ndarray, demand: np.ndarray, room: int, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) of the final basis and how often the linear program takes each."""
    per = room // sizes
    columns = np.diag(per).astype(float)
    inverse, x = np.diag(1.0 / per), demand / per
    for _ in range(max_steps):
        value, column = knapsack(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-9:
            break
        way = (inverse * column).sum(axis=1)
        ratios = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        columns[:, out] = column
        pivot = inverse[out] / way[out]
        x = np.maximum(0, x - ratios[out] * way)
        x[out] = ratios[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
    return columns.astype(np.int64), x


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns, as number of pieces by size, with whole repetitions that use up the histogram."""
    out = [({room: 1}, histogram[room])] if histogram.get(room) else []
    sizes = np.array(sorted(s for s, n in histogram.items() if s < room and n), dtype=np.int64)
    if not len(sizes):
        return out
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    columns, x = generate_columns(sizes, left.astype(float), room)
    for j in np.argsort(-x, kind="stable"):
        a = columns[:, j]
        if not a.any():
            continue
        n = int(min(np.floor(x[j] + 1e-9), (left[a > 0] // a[a > 0]).min()))
        if n > 0:
            out.append(({int(s): int(k) for s, k in zip(sizes, a) if k}, n))
            left -= n * a
    rooms: list[int] = []  # of open sequences, ascending, for the rest: best fit, largest piece first
    bins: list[dict[int, int]] = []
    order: list[int] = []
    for s, n in sorted(zip(sizes.tolist(), left.tolist()), reverse=True):
        for _ in range(n):
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                bins.append({})
                free, b = room, len(bins) - 1
            else:
                free, b = rooms.pop(i), order.pop(i)
            bins[b][s] = bins[b].get(s, 0) + 1
            i = bisect.bisect_left(rooms, free - s)
            rooms.insert(i, free - s)
            order.insert(i, b)
    return out + [(b, 1) for b in bins]


def intervals(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By size: rows of first rank, first sequence, pieces in each sequence, first place in it."""
    rank: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for pattern, n in patterns:
        place = 0
        for s, k in sorted(pattern.items(), reverse=True):
            out.setdefault(s, []).append((rank.get(s, 0), sequence, k, place))
            rank[s] = rank.get(s, 0) + n * k
            place += k
        sequence += n
    return {s: np.array(v, dtype=np.int64) for s, v in out.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity).withColumn("__size", F.expr(f"int((length + {width - 1}) div {width})")))
    ranked = local_prefix(cut, ["__size", "length", "doc_id", "start", "ids_crc32"], None, group="__size")
    counts = ranked.groupBy("__pid", "__size").agg(F.count("*").alias("n")).collect()  # as many as partitions and sizes at most
    histogram: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for pid, size, n in sorted(counts):
        before[pid, size] = histogram.get(size, 0)
        histogram[size] = histogram.get(size, 0) + n
    shared = spark.sparkContext.broadcast((before, intervals(plan(histogram, capacity // width))))
    schema = ranked.drop("__row", "__before").schema.add("sequence_id", "long").add("__place", "long")

    def place(batches):
        offsets, table = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            pid, size, rank = col("__pid"), col("__size"), col("__row").copy()
            sequence, spot = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            keys = size.astype(np.int64) * (1 << 32) + pid
            for key in np.unique(keys):
                at = keys == key
                s = int(key >> 32)
                rank[at] += offsets[int(key & 0xFFFFFFFF), s]
                rows = table[s][np.searchsorted(table[s][:, 0], rank[at], side="right") - 1]
                gone = rank[at] - rows[:, 0]
                sequence[at], spot[at] = rows[:, 1] + gone // rows[:, 2], rows[:, 3] + gone % rows[:, 2]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(spot)], names=schema.names)

    placed = ranked.mapInArrow(place, schema)
    in_sequence = Window.partitionBy("sequence_id").orderBy("__place")  # 1024 pieces at most
    return placed.withColumn("offset", F.sum("length").over(in_sequence) - F.col("length")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
