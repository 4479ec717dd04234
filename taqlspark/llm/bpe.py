"""Byte-level BPE by overlapping chunks: parallel pre-tokenisation, stitching, encoding, decoding.

A text is cut into overlapping chunks at fixed places. Each chunk is pre-tokenised on its own, from
its first character, which may be the middle of a pre-token. Pre-tokenising is a left-to-right scan
without memory: once two scans share a border, they agree from there on. So the chunks of a text are
stitched at the first border that the scan from the left shares with the chunk's own scan; where the
overlap holds none (a single pre-token longer than it), the scan from the left goes on until it meets
one. The pieces between stitches are encoded, and decoding joins the bytes of the ids.

Texts of one chunk need no stitching and stay in their task. Chunks of longer texts are dealt to all
tasks and gathered by text, so a group is never larger than the text it comes from.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import batches_of

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 16_384, 256


class Coder:
    """Ranks and pattern of a vocabulary; one per worker and file."""

    _kept: dict[tuple[str, str], "Coder"] = {}

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    @classmethod
    def of(cls, path: str, pattern: str) -> "Coder":
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    def borders(self, text: str, start: int, stop: int) -> list[int]:
        """Starts of the pre-tokens of a scan of text[start:stop], and ``stop``.

        Those within the last pre-tokens may differ from a scan of the whole text; see ``stitch``.
        """
        out = [m.start() for m in self.pattern.finditer(text, start, stop)]
        out.append(stop)
        return out

    def encode(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            out += self.coding.encode_ordinary(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, joined; they need not be whole characters."""
        return self.coding.decode_bytes(ids)


def chunk_starts(n: int, chunk: int) -> list[int]:
    """Where the chunks of a text of n characters begin; a text of one chunk begins at 0."""
    return list(range(0, max(n, 1), chunk))


def stitch(text: str, scans: list[list[int]], starts: list[int], rescan: Callable[[int, int], list[int]]) -> list[str]:
    """Cut ``text`` at true borders near the starts of its chunks.

    scans: the borders that each chunk found on its own, the last one its end. The end of a scan, and
    the border before it, depend on what the chunk couldn't see, so they aren't used unless the chunk
    ends the text. rescan(a, b): borders of a scan from a to b, where no border is shared in time.
    """
    cuts, n = [0], len(text)
    here = scans[0]
    for k in range(1, len(scans)):
        there, step = scans[k], starts[1] - starts[0]
        while True:
            # white space before the end can still move two borders, so the last three are left out
            sure = here if here[-1] >= n else here[:-3]
            last = there if there[-1] >= n else there[:-3]
            known = set(last)
            i = bisect.bisect_left(sure, starts[k])
            shared = next((b for b in sure[i:] if b in known and b < n), None)
            if shared is not None or sure and sure[-1] >= n:
                break
            begin = sure[-1] if sure else here[0]
            if last and begin >= last[-1] or here[-1] >= n:
                break  # the scan from the left has passed all that this chunk knows
            here = [*sure[:-1], *rescan(begin, min(n, here[-1] + step))]
        if shared is not None:
            cuts.append(shared)
            here = there[bisect.bisect_left(there, shared) :]
    cuts.append(n)
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _digest(ids: list[int], coder: Coder) -> tuple[int, str, str]:
    return (
        len(ids),
        hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(coder.decode(ids)).hexdigest(),
    )


def encode_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>, decoded binary]) for each row.

    A null text counts as empty: no ids, no bytes. Repeated rows and null ids each give their own
    row. Columns other than the two named are not read.
    """
    batches_of(docs.sparkSession)
    more = ", ids array<int>, decoded binary" if keep_ids else ""
    schema = f"id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def row(coder: Coder, pieces: list[str]) -> tuple:
        ids = coder.encode(pieces)
        return (*_digest(ids, coder), *((ids, coder.decode(ids)) if keep_ids else ()))

    def batch(keys: list, rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        columns = [keys, *(zip(*rows, strict=True) if rows else [[]] * (len(names) - 1))]
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=False)], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)
        for b in batches:
            yield batch(b.column(0).to_pylist(), [row(coder, [t or ""]) for t in b.column(1).to_pylist()])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    short = own.where(~is_long).mapInArrow(whole, schema)

    # a chunk sees `overlap` characters of the next one
    starts = F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(chunk))
    chunks = (
        own.where(is_long)
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "id", "text", F.posexplode(starts).alias("k", "start"))
        .select("row", "id", "k", F.expr(f"substring(text, start + 1, {chunk + overlap})").alias("part"))
        .repartition("row", "k")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)
        for b in batches:
            found = [coder.borders(t, 0, len(t)) for t in b.column(3).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(found, pa.list_(pa.int32()))], names=["row", "id", "k", "part", "borders"])

    def join(table: pa.Table) -> pa.Table:
        coder = Coder.of(path, pattern)
        table = table.sort_by("k")
        parts, scans = table["part"].to_pylist(), table["borders"].to_pylist()
        text = "".join([*(p[:chunk] for p in parts[:-1]), parts[-1]])
        begin = [k * chunk for k in table["k"].to_pylist()]
        at = [[b + s for b in bs] for bs, s in zip(scans, begin, strict=True)]
        pieces = stitch(text, at, begin, lambda a, b: coder.borders(text, a, b))
        return pa.Table.from_batches([batch(table["id"].to_pylist()[:1], [row(coder, pieces)])])

    scanned = chunks.mapInArrow(scan, "row long, id long, k int, part string, borders array<int>")
    return short.unionByName(scanned.groupBy("row").applyInArrow(join, schema))
