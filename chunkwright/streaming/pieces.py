"""Chunks of documents that arrive in pieces, in any order and any split into micro-batches.

State is kept for each document: the text since the next window's start (less than a window), the
next window's number and place, and pieces that came before their turn. A window is emitted as soon
as its last character has arrived, so a document of any length holds a window's worth of text. The
last piece closes the document. With an expiry, one that stays open so long without a new piece is
closed with what has arrived in order, marked as incomplete, and its state goes; pieces that still
come begin anew. Without one, documents stay open (a stream that ends by itself, as with the trigger
availableNow, takes none: Spark would wait for timeouts for ever).

The result is that of the same windows over the whole text (operators.chunking.fixed_windows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: pieces: how many the document has; null until it is known, the last piece at the latest names it.
PIECES = "doc_id long, piece int, pieces int, text string"
CHUNKS = "doc_id long, chunk_index long, start_char long, end_char long, content string, complete boolean"
STATE = "next int, pieces int, start long, index long, tail string, held_piece array<int>, held_text array<string>"


@dataclass
class Open:
    """A document that isn't closed yet."""

    size: int
    overlap: int
    next: int = 0
    pieces: int = -1
    start: int = 0
    index: int = 0
    tail: str = ""
    held: dict[int, str] = field(default_factory=dict)

    def take(self, piece: int, pieces: int | None, text: str) -> None:
        if pieces is not None:
            self.pieces = pieces
        if piece >= self.next:  # a piece that comes again is passed over
            self.held.setdefault(piece, text)

    def windows(self) -> Iterator[tuple[int, int, str]]:
        """The windows that are full by now: index, start, content."""
        while self.next in self.held:
            self.tail += self.held.pop(self.next)
            self.next += 1
            while len(self.tail) >= self.size:
                yield self.index, self.start, self.tail[: self.size]
                self._on()

    def _on(self) -> None:
        step = self.size - self.overlap
        self.index, self.start, self.tail = self.index + 1, self.start + step, self.tail[step:]

    def rest(self) -> Iterator[tuple[int, int, str]]:
        """The last window, if it has more than the overlap."""
        if self.index == 0 or len(self.tail) > self.overlap:
            yield self.index, self.start, self.tail

    @property
    def closed(self) -> bool:
        return self.next == self.pieces


def chunker(size: int, overlap: int, expiry: int | None):
    """The function that applyInPandasWithState calls for each document of a micro-batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        doc = Open(size, overlap)
        if state.exists:
            doc.next, doc.pieces, doc.start, doc.index, doc.tail, numbers, texts = state.get
            doc.held = dict(zip(numbers, texts))
        out = []
        if not state.hasTimedOut:
            for frame in frames:
                for piece, pieces, text in zip(frame["piece"], frame["pieces"], frame["text"]):
                    doc.take(int(piece), None if pd.isna(pieces) else int(pieces), text or "")
                out += [(*w, True) for w in doc.windows()]
        if state.hasTimedOut or doc.closed:
            out += [(*w, doc.closed) for w in doc.rest()]
            state.remove()
        else:
            state.update((doc.next, doc.pieces, doc.start, doc.index, doc.tail, list(doc.held), list(doc.held.values())))
            if expiry is not None:
                state.setTimeoutDuration(expiry)
        yield pd.DataFrame(
            [(key[0], index, start, start + len(content), content, complete) for index, start, content, complete in out],
            columns=["doc_id", "chunk_index", "start_char", "end_char", "content", "complete"],
        )

    return run


def chunked(pieces: DataFrame, size: int = 1024, overlap: int = 128, expiry_seconds: int | None = None) -> DataFrame:
    """CHUNKS of a stream of PIECES."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    keyed = pieces.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(piece AS INT) AS piece", "CAST(pieces AS INT) AS pieces", "text").where("doc_id IS NOT NULL AND piece >= 0")
    timeout, expiry = (GroupStateTimeout.NoTimeout, None) if expiry_seconds is None else (GroupStateTimeout.ProcessingTimeTimeout, expiry_seconds * 1000)
    return keyed.groupBy("doc_id").applyInPandasWithState(chunker(size, overlap, expiry), CHUNKS, STATE, "append", timeout)
