"""Documents in pieces: any split into micro-batches gives the chunks of the whole text."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from chunkwright.operators.chunking import fixed_windows
from chunkwright.streaming import pieces as P


def cut(rng, text):
    places = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 6)))
    return [text[a:b] for a, b in zip([0, *places], [*places, len(text)])]


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_of_pieces_equals_the_batch(spark, tmp_path, batches):
    rng = random.Random(batches)
    texts = {i: "".join(rng.choice("ab c\né😀") for _ in range(n)) for i, n in enumerate([0, 1, 15, 16, 17, 20, 32, 44, 45, 300, 999, *(rng.randint(0, 200) for _ in range(30))])}
    rows = [(i, k, None if rng.random() < 0.3 and k + 1 < len(parts) else len(parts), part) for i, text in texts.items() for parts in [cut(rng, text)] for k, part in enumerate(parts)]
    rows += rng.sample(rows, 20)  # some pieces come again
    rng.shuffle(rows)
    for b in range(batches):
        spark.createDataFrame(rows[b::batches], P.PIECES).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    arriving = spark.readStream.schema(P.PIECES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running = P.chunked(arriving, 16, 4).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert running.awaitTermination(60)
    got = sorted(tuple(r) for r in spark.read.schema(P.CHUNKS).parquet(f"{tmp_path}/out").collect())
    whole = fixed_windows(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 16, 4)
    want = sorted((r["doc_id"], r["chunk_index"], r["start_char"], r["end_char"], r["content"], True) for r in whole.collect())
    assert [g for g in got if g[0] not in again(rows, texts)] == [w for w in want if w[0] not in again(rows, texts)]


def again(rows, texts):
    """Documents of which a piece came again after they were closed: such pieces open a new document."""
    out = set()
    for i in texts:
        seen, total = set(), max(r[2] or 0 for r in rows if r[0] == i)
        for r in rows:
            if r[0] == i:
                if len(seen) == total:
                    out.add(i)
                seen.add(r[1])
    return out


class State:
    """What the function sees of Spark's state."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, milliseconds):
        self.timeout = milliseconds


def test_an_open_document_expires_with_what_came_in_order():
    run, state = P.chunker(4, 1, 5000), State()
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["piece", "pieces", "text"])])
    first = pd.concat(run((7,), frame((0, None, "abcde"), (2, 3, "never reached")), state))
    assert first["content"].tolist() == ["abcd"] and state.timeout == 5000 and state.exists
    state.hasTimedOut = True
    last = pd.concat(run((7,), iter([]), state))
    assert last[["content", "start_char", "complete"]].values.tolist() == [["de", 3, False]] and not state.exists


def test_state_holds_less_than_a_window():
    doc = P.Open(100, 20)
    for k in range(1000):
        doc.take(k, None, "x" * 37)
        list(doc.windows())
        assert len(doc.tail) < 100 and not doc.held


def test_overlap_must_fit(spark):
    with pytest.raises(ValueError):
        P.chunked(spark.createDataFrame([], P.PIECES), 10, 10)
