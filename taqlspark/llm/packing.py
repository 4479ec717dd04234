"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has room for a number of tokens, of segments and of loss-bearing tokens. Each example asks
for some of all three. It goes to the open sequence where the inner product of what it asks for and
what is still free, both as shares of the limits, is largest among those it fits. Where none fits
and no more may be opened, an example is cut: its head fills the sequence that has the most room, so
that one closes full. A sequence with one segment left takes only a piece that fills it.

Every task packs its own examples and holds only a few open sequences. What is still open at a task's
end is dealt again into full sequences, and the last one is cut into lengths that are powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import batches_of
from .pieces import CACHE_ENTRIES, ENCODED_ROWS, PieceEncoder
from .workers import tidy

#: Limits of a sequence, and sequences that a task holds open.
TOKENS, SEGMENTS, OPEN = 4096, 512, 16


@dataclass
class Limits:
    """What a sequence may hold."""

    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int = TOKENS
    open: int = OPEN


@dataclass
class Example:
    """A run of tokens; those from loss_start on bear loss (a prompt before them doesn't)."""

    key: object
    start: int
    length: int
    loss_start: int

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.loss_start))

    def head(self, length: int) -> Example:
        return Example(self.key, self.start, length, self.loss_start)

    def rest(self, length: int) -> Example:
        return Example(self.key, self.start + length, self.length - length, self.loss_start)


@dataclass
class Bin:
    """An open sequence: what is free, and its pieces."""

    tokens: int
    segments: int
    loss: int
    pieces: list[Example] = field(default_factory=list)

    def longest(self, x: Example) -> int:
        """Longest head of x that fits."""
        if self.segments < 1:
            return 0
        most = min(x.length, self.tokens)
        if x.loss(most) > self.loss:
            most = max(0, x.loss_start - x.start) + self.loss
        return most

    def put(self, x: Example) -> None:
        self.tokens -= x.length
        self.segments -= 1
        self.loss -= x.loss(x.length)
        self.pieces.append(x)


class Packer:
    """Packs a stream of examples; ``add`` and ``finish`` yield the pieces of closed sequences."""

    def __init__(self, limits: Limits) -> None:
        if min(limits.tokens, limits.segments, limits.loss, limits.open) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.bins = limits, []

    def _new(self) -> Bin:
        return Bin(self.limits.tokens, self.limits.segments, self.limits.loss)

    def _done(self, b: Bin) -> bool:
        return b.tokens == 0 or b.segments == 0

    def add(self, x: Example) -> Iterator[list[Example]]:
        n = self.limits
        while x.length:
            best, score = None, -1.0
            loss = x.loss(x.length)
            for b in self.bins:
                if x.length <= b.tokens and loss <= b.loss and (b.segments > 1 or x.length == b.tokens):
                    s = x.length * b.tokens / n.tokens**2 + b.segments / n.segments**2 + loss * b.loss / n.loss**2
                    if s > score:
                        best, score = b, s
            if best is not None:
                best.put(x)
                x = x.rest(x.length)
            elif len(self.bins) < n.open:
                best = self._new()
                self.bins.append(best)
                size = best.longest(x)
                best.put(x.head(size))
                x = x.rest(size)
            else:
                # fill one up: the one that takes most of the example, of equals the fullest
                best = max(self.bins, key=lambda b: (b.longest(x), -b.tokens))
                size = best.longest(x)
                if size:
                    best.put(x.head(size))
                    x = x.rest(size)
                else:  # no room in any dimension the example needs: close the fullest
                    best = min(self.bins, key=lambda b: b.tokens)
                    self.bins.remove(best)
                    yield best.pieces
                    continue
            if self._done(best):
                self.bins.remove(best)
                yield best.pieces

    def finish(self) -> Iterator[list[Example]]:
        """Deal what is open into full sequences, then into lengths that are powers of two."""
        left = [p for b in self.bins for p in b.pieces]
        self.bins = []
        b = self._new()
        for x in left:
            while x.length:
                size = b.longest(x)
                if size:
                    b.put(x.head(size))
                    x = x.rest(size)
                if self._done(b) or not size:
                    yield b.pieces
                    b = self._new()
        total = sum(p.length for p in b.pieces)
        pieces = b.pieces[::-1]
        while total:
            want = 1 << (total.bit_length() - 1)
            out = []
            while want:
                x = pieces.pop()
                size = min(want, x.length)
                out.append(x.head(size))
                if size < x.length:
                    pieces.append(x.rest(size))
                want -= size
                total -= size
            yield out


def pack_examples(examples: DataFrame, limits: Limits | None = None, id_col: str = "id", length_col: str = "length", loss_start_col: str | None = None) -> DataFrame:
    """Pack examples of known lengths: (id string, start, length, sequence_id, offset), one row per piece.

    Null or negative lengths count as 0 and give no piece; a null loss start counts as 0. Ids may be
    null or repeat. Other columns are not read.
    """
    batches_of(examples.sparkSession)
    own = limits or Limits()
    loss = F.coalesce(F.col(loss_start_col).cast("long"), F.lit(0)) if loss_start_col else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Packer(own), TaskContext.get().partitionId() << 40
        made = 0

        def out(groups: Iterator[list[Example]]) -> list[tuple]:
            nonlocal made
            rows = []
            for pieces in groups:
                offset = 0
                for p in pieces:
                    rows.append((p.key, p.start, p.length, first + made, offset))
                    offset += p.length
                made += 1
            return rows

        for b in batches:
            rows = []
            for key, n, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += out(packer.add(Example(key, 0, max(0, n), s)))
            yield _table(rows, _PIECES)
        yield _table(out(packer.finish()), _PIECES)

    return examples.select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("n"), loss.alias("s")
    ).mapInArrow(run, "id string, start long, length long, sequence_id long, offset long")


_PIECES = [("id", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_TEXTS = [
    ("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
]


def _table(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.record_batch([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def pack_texts(
    docs: DataFrame, tokenizer: str, end_id: int | None = 2, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, cache_entries: int = CACHE_ENTRIES
) -> DataFrame:
    """Encode whole texts and pack all their ids; one row per piece.

    (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids binary: little-endian u32]).
    start counts the document's ids before the piece, offset the sequence's; every id lies in exactly
    one piece. All tokens of a text bear loss. A null text counts as empty; with ``end_id`` it still
    has one id, without it no piece. Ids may be null or repeat. Other columns are not read.
    sequence_id is unique over the result; it holds the task and a running number. cache_entries bounds
    the encoder's cache; where workers serve other steps too, fewer leave them more memory.
    """
    batches_of(docs.sparkSession, ENCODED_ROWS)
    own = limits or Limits()
    kinds = _TEXTS if keep_ids else _TEXTS[:-1]
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer, words=True)
        packer, first = Packer(own), TaskContext.get().partitionId() << 40
        made = 0

        def out(groups: Iterator[list[Example]]) -> list[tuple]:
            nonlocal made
            rows = []
            for pieces in groups:
                offset = 0
                for p in pieces:
                    key, ids = p.key
                    raw = ids[4 * p.start : 4 * (p.start + p.length)]
                    row = (key, p.start, p.length, zlib.crc32(raw), len(ids) // 4, first + made, offset)
                    rows.append((*row, raw) if keep_ids else row)
                    offset += p.length
                made += 1
            return rows

        for b in batches:
            rows = []
            for key, ids in zip(b.column(0).to_pylist(), encoder.ids(b.column(1), cache_entries), strict=True):
                ids += end
                rows += out(packer.add(Example((key, ids), 0, len(ids) // 4, 0)))
            yield _table(rows, kinds)
        yield _table(out(packer.finish()), kinds)

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
