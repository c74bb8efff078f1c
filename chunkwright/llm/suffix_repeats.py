"""Repeated passages by sparse suffix arrays.

Only the suffixes that start at minimisers (the least hash of SAMPLE-word shingles in every WINDOW of
them, so chosen by content alone) are retained. Any repeat of SAMPLE + WINDOW - 1 words holds a
retained position in both places. Positions whose first words stand in one text only are dropped;
the other suffixes are sorted over all texts, dealt out in ranges with the text as tie-break so that
a frequent passage spreads over partitions, and each is compared to its neighbours of other texts,
in other partitions too where a text's run of suffixes reaches its partition's edge:
the match is extended to the right from the position and to the left of it. They are sorted twice,
by what follows and by what stands before, so that the longest match on either side is a neighbour. Matches of `least` words
are repeated passages; longer ones are covered by the matches at their further minimisers.

Defined results: null text is empty; texts under `least` words have no passages; very long texts are
read whole; texts that are equal throughout are one passage; repeats within one text alone don't
count; suffixes that are equal in all they hold are ordered by text and position; null or repeated
doc_ids and repeated rows each give their rows; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import WordIds, map_rows, materialize, mix, shingle_hashes, text_of
from chunkwright.llm.order_minhash import distinct_texts, text_key

LEAST = 50
SAMPLE, WINDOW = 8, 33
#: Words of a suffix that are sorted and compared, and of what stands before it.
RIGHT, LEFT = LEAST, SAMPLE + WINDOW


def minimisers(shingles: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash in each window (the first of equal ones)."""
    if len(shingles) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(mix(shingles), window)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def samples(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_words, retained positions and the hashes of the shingles there."""

    def make() -> Callable:
        words = WordIds()

        def run(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": rows["doc_id"], "key": rows["key"], "n_words": [], "positions": [], "hashes": []}
            for text in rows["text"]:
                ids = words.array(text.split())
                shingles = shingle_hashes(ids, SAMPLE) if len(ids) >= LEAST else ids[:0]
                at = minimisers(shingles)
                out["n_words"].append(len(ids))
                out["positions"].append(at)
                out["hashes"].append(shingles[at].view(np.int64))
            return out

        return run

    return map_rows(docs.select("doc_id", text_key().alias("key"), text_of().alias("text")), make, "doc_id long, key binary, n_words int, positions array<int>, hashes array<long>")


def suffixes(texts: DataFrame) -> DataFrame:
    """A row for each retained suffix: its words and those before it (backwards), four bytes each. texts: key, text, positions."""

    def make() -> Callable:
        words = WordIds()

        def run(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"key": [], "position": [], "right": [], "left": []}
            for key, text, positions in zip(rows["key"], rows["text"], rows["positions"]):
                ids = (words.array(text.split()) & np.uint64(0xFFFFFFFF)).astype(">u4")
                for p in positions:
                    out["key"].append(key)
                    out["position"].append(p)
                    out["right"].append(ids[p : p + RIGHT].tobytes())
                    out["left"].append(ids[max(0, p - LEFT) : p][::-1].tobytes())
            return out

        return run

    return map_rows(texts.select("key", "text", "positions"), make, "key binary, position int, right binary, left binary")


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(v.ljust(4 * width, b"\0") for v in values), dtype=">u4").reshape(len(values), width)
    return flat, np.array([len(v) // 4 for v in values], np.int64)


def _common(m: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words rows i and j share from their start."""
    same = m[0][i] == m[0][j]
    return np.minimum(np.cumprod(same, axis=1).sum(axis=1), np.minimum(m[1][i], m[1][j]))


class _Rows:
    """Sorted suffixes in memory."""

    def __init__(self, key: list[bytes], position: list[int], right: list[bytes], left: list[bytes]):
        self.key, self.position = np.array(key, dtype=object), np.array(position, np.int64)
        self.right, self.left = _matrix(right, RIGHT), _matrix(left, LEFT)

    def matches(self, i: np.ndarray, j: np.ndarray, least: int) -> tuple[list, np.ndarray, np.ndarray]:
        """key, start, end of row i's side of the matches of rows i and j."""
        right, left = _common(self.right, i, j), _common(self.left, i, j)
        far = right + left >= least
        return self.key[i[far]].tolist(), (self.position[i] - left)[far], (self.position[i] + right)[far]


NEIGHBOURS = "key binary, start int, end int, pid int, edge int, position int, right binary, left binary"
#: Values of edge: rows with no other text before or after them in their partition; the partition's outer rows of two texts on either side (start: 0, 1).
BEFORE, AFTER, FIRST, LAST = range(4)


FIELDS = ("key", "position", "right", "left")


def _neighbour_rows(spans: list[tuple], edges: list[tuple], pid: int) -> pa.RecordBatch:
    """A batch of NEIGHBOURS: spans (key, start, end) and edges (row, edge, rank)."""
    none = [None] * len(spans)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*(k for k, _, _ in spans), *(r[0] for r, *_ in edges)], pa.binary()),
            pa.array([*(s for _, s, _ in spans), *(rank for *_, rank in edges)], pa.int32()),
            pa.array([*(e for *_, e in spans), *[None] * len(edges)], pa.int32()),
            pa.array([*none, *[pid] * len(edges)], pa.int32()),
            pa.array([*none, *(e for _, e, _ in edges)], pa.int32()),
            *(pa.array([*none, *(r[c] for r, *_ in edges)], kind) for c, kind in ((1, pa.int32()), (2, pa.binary()), (3, pa.binary()))),
        ],
        names=["key", "start", "end", "pid", "edge", "position", "right", "left"],
    )


def compared(sorted_suffixes: DataFrame, least: int) -> DataFrame:
    """Matches with the nearest neighbours of other texts, the rows whose neighbour is in another partition, and each partition's outer rows.

    Rows stream by: what is held is a batch, the run of one text's rows that wait for the next text's,
    and the row before that run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held: list[tuple] = []  # rows of the last text, behind the last row of another one
        waiting, firsts = 0, 0  # how many of those still want the row after them; outer rows of two texts found at the start
        for batch in batches:
            if not batch.num_rows:
                continue
            known = len(held)
            table = held + list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in FIELDS)))
            n = len(table)
            rows = _Rows(*map(list, zip(*table)))
            at = np.arange(n)
            new = np.r_[True, rows.key[1:] != rows.key[:-1]].astype(bool)
            before = np.maximum.accumulate(np.where(new, at, 0)) - 1  # the last row of another text
            after = np.minimum.accumulate(np.where(np.r_[new[1:], True], at, n)[::-1])[::-1] + 1
            fresh, open_ = at >= known, at >= known - waiting
            spans: list[tuple] = []
            for mine, other in ((fresh & (before >= 0), before), (open_ & (after < n), after)):
                i = at[mine]
                k, start, end = rows.matches(i, other[mine], least)
                spans += zip(k, start.tolist(), end.tolist())
            edges = [(table[x], BEFORE, None) for x in at[fresh & (before < 0)]]
            if not firsts:
                edges.append((table[0], FIRST, 0))
                firsts = 1
            if firsts == 1 and (before >= 0).any():
                edges.append((table[int(at[before >= 0][0])], FIRST, 1))
                firsts = 2
            yield _neighbour_rows(spans, edges, pid)
            tail = int(before[-1]) + 1
            waiting = n - tail
            held = table[max(0, tail - 1) :]
        if held:
            other = held[:-waiting]
            yield _neighbour_rows([], [*((r, AFTER, None) for r in held[-waiting:]), (held[-1], LAST, 0), *((r, LAST, 1) for r in other)], pid)

    return sorted_suffixes.mapInArrow(run, NEIGHBOURS)


def nearest_outside(edges: list) -> dict[tuple[int, int], list]:
    """(key, position, right, left) of the nearest rows of two texts beyond each partition, by its number and side. edges: the FIRST and LAST rows."""
    outer: dict[tuple[int, int], list] = {}
    for r in sorted(edges, key=lambda r: r["start"]):
        outer.setdefault((r["pid"], r["edge"]), []).append((bytes(r["key"]), r["position"], bytes(r["right"]), bytes(r["left"])))
    pids = sorted({pid for pid, _ in outer})
    found = {}
    for side, facing, order in ((BEFORE, LAST, pids), (AFTER, FIRST, pids[::-1])):
        near: list = []
        for pid in order:
            found[pid, side] = near
            rows = outer[pid, facing] + near
            near = [rows[0], *[r for r in rows if r[0] != rows[0][0]][:1]]
    return found


def across_partitions(side: DataFrame, least: int) -> DataFrame:
    """key, start, end of the matches of rows with their nearest neighbours of other texts in other partitions."""
    edges = side.where(f"edge >= {FIRST}").collect()  # four rows for each partition at most
    outside = side.sparkSession.sparkContext.broadcast(nearest_outside(edges))

    def make() -> Callable:
        near = outside.value

        def run(rows: dict[str, list]) -> dict[str, list]:
            own = list(zip(rows["key"], rows["position"], rows["right"], rows["left"]))
            pairs = [(r, next((x for x in near[at] if x[0] != r[0]), None)) for r, at in zip(own, zip(rows["pid"], rows["edge"]))]
            flat = [r for pair in pairs if pair[1] for r in pair]
            if not flat:
                return {"key": [], "start": [], "end": []}
            i = np.arange(0, len(flat), 2)
            key, start, end = _Rows(*map(list, zip(*flat))).matches(i, i + 1, least)
            return {"key": key, "start": start, "end": end}

        return run

    return map_rows(side.where(f"edge < {FIRST}").select("key", "pid", "edge", "position", "right", "left"), make, "key binary, start int, end int")


def merged(spans: DataFrame) -> DataFrame:
    """key, start, end with touching and overlapping spans of a text made one."""
    lots = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def make() -> Callable:
        def run(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"key": [], "start": [], "end": []}
            for key, lot in zip(rows["key"], rows["spans"]):
                lot = sorted((s["start"], s["end"]) for s in lot)
                start, end = lot[0]
                for s, e in [*lot[1:], (1 << 40, 0)]:
                    if s <= end:
                        end = max(end, e)
                        continue
                    for name, value in (("key", key), ("start", start), ("end", end)):
                        out[name].append(value)
                    start, end = s, e
            return out

        return run

    return map_rows(lots, make, "key binary, start int, end int")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words of every passage of `least` words that stands in another row too."""
    spark = docs.sparkSession
    rows = materialize(samples(docs))
    texts = materialize(distinct_texts(rows, "n_words", "positions", "hashes"))
    every = texts.where("size(positions) > 0").select("key", F.explode(F.arrays_zip("positions", "hashes")).alias("x")).select("key", F.col("x.positions").alias("position"), F.col("x.hashes").alias("hash"))
    mark = F.xxhash64("key")
    # written first, so that both sides of the join come from shuffles and a frequent hash's partition can be split
    common = every.groupBy("hash").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("hash")
    common = materialize(common)
    wanted = every.join(common, "hash", "left_semi").groupBy("key").agg(F.collect_list("position").alias("positions")).join(texts.select("key", "doc_id"), "key")
    source = docs.select(text_key().alias("k"), F.col("doc_id").alias("id"), text_of().alias("text"))
    held = source.join(wanted, (source["k"] == wanted["key"]) & source["id"].eqNullSafe(wanted["doc_id"])).select("key", "text", "positions")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    retained = materialize(suffixes(held))
    retained = retained.withColumn("head", F.substring("right", 1, 4 * SAMPLE))
    spans = None
    # by what follows, ties by what stands before; then, among equal samples, by what stands before, ties by what follows
    for order in (["right", "left", "key", "position"], ["head", "left", "right", "key", "position"]):
        side = materialize(compared(retained.repartitionByRange(parts, *order).sortWithinPartitions(*order), least))
        found = side.where("edge IS NULL").select("key", "start", "end").union(across_partitions(side, least))
        spans = found if spans is None else spans.union(found)
    whole = texts.where(f"copies > 1 AND n_words >= {least}").select("key", F.lit(0).alias("start"), F.col("n_words").alias("end"))
    return rows.select("doc_id", "key").join(merged(spans.union(whole)), "key").select(
        "doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words")
    )
