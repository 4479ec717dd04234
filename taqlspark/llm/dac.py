"""Token ids in directly addressable codes.

A shard holds the ids of a run of documents. Each id is split into 8-bit chunks: level 0 has the low
chunk of every id, level 1 the next chunk of those ids that have one, and so on. A bitmap per level
says which ids go on, and a rank directory (set bits before each block of 512) turns a position in
one level into the position in the next, so any id is read with one step per level and no decoding
of its neighbours.

Shard layout, little-endian:

    8 bytes   magic ``DACTOK1\\n``
    u32 x 2   documents, levels
    u64       ids
    i64 x d   doc_id
    u8  x d   1 if the doc_id is not null
    u64 x d+1 first id of each document within the shard, then the number of ids
    per level u64 codes, u64 bitmap bytes, u64 directory entries, then those three parts
              (u8 codes; bitmap, low bit first; u64 set bits before each block of 512)

Documents are range-partitioned and sorted by id, so shards in the order of their names hold all ids
in ascending document order. A shard is written under a passing name and then moved, so a task that
runs twice leaves the same file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import batches_of, partitions_for, stage
from .pieces import ENCODED_ROWS, PieceEncoder
from .workers import tidy

MAGIC = b"DACTOK1\n"
#: Bits a rank entry covers, and ids after which a shard is closed.
BLOCK, SHARD_IDS = 512, 4_000_000


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, bitmap, directory) of each level of unsigned 32-bit ids."""
    rest, levels = ids.astype(np.uint32, copy=False), []
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        pad = -len(bitmap) % (BLOCK // 8)
        ones = np.bitwise_count(np.append(bitmap, np.zeros(pad, np.uint8)).reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint64)
        directory = np.append(np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64))[:-1] if len(ones) else np.zeros(0, np.uint64)
        levels.append(((rest & 0xFF).astype(np.uint8), bitmap, directory))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


def write_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    levels = encode_levels(ids)
    out = [
        MAGIC,
        struct.pack("<IIQ", len(doc_ids), len(levels), len(ids)),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is not None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.append(0, np.cumsum(counts, dtype=np.int64)).astype("<u8").tobytes(),
    ]
    for codes, bitmap, directory in levels:
        out.append(struct.pack("<QQQ", len(codes), len(bitmap), len(directory)))
        out += [codes.tobytes(), bitmap.tobytes(), directory.astype("<u8").tobytes()]
    return b"".join(out)


class Shard:
    """A shard's bytes, read in place."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        docs, levels, self.n = struct.unpack_from("<IIQ", data, 8)
        at = 24
        known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(data, "<i8", docs, at), known, strict=True)]
        at += 9 * docs
        self.starts = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            c, b, d = struct.unpack_from("<QQQ", data, at)
            at += 24
            self.levels.append((np.frombuffer(data, np.uint8, c, at), np.frombuffer(data, np.uint8, b, at + c), np.frombuffer(data, "<u8", d, at + c + b)))
            at += c + b + 8 * d

    def rank(self, level: int, i: int) -> int:
        """Set bits before bit i: a directory entry and at most one block of the bitmap."""
        _, bitmap, directory = self.levels[level]
        block = i // BLOCK
        lead = bitmap[block * BLOCK // 8 : i // 8]
        ones = int(directory[block]) + int(np.bitwise_count(lead).sum())
        return ones + int(bitmap[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else ones

    def __getitem__(self, i: int) -> int:
        """The id at position i of the shard."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for level, (codes, bitmap, _) in enumerate(self.levels):
            value |= int(codes[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i, shift = self.rank(level, i), shift + 8
        return value

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop: each level's run is found by two ranks."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        value, at = self.levels[0][0][start:stop].astype(np.uint32), None
        for level in range(1, len(self.levels)):
            bitmap = self.levels[level - 1][1]
            bits = np.unpackbits(bitmap[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start]
            go_on = np.flatnonzero(bits)
            if not len(go_on):
                break
            at = go_on if at is None else at[go_on]
            start = self.rank(level - 1, start)
            stop = start + len(at)
            value[at] |= self.levels[level][0][start:stop].astype(np.uint32) << np.uint32(8 * level)
        return value


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Write the ids of all texts as shards below ``path`` (a folder that executors share) and return the manifest.

    Documents go in ascending id, null ids first, equal ids by their texts. A null text counts as empty
    and still gets ``end_id``. Every row is written, repeated rows too; no rows leave no shards. A
    shard closes after ``shard_ids`` ids; a document is never split, and a document longer than that
    has a shard of its own. Columns other than the two named are not read.

    Manifest: (file string, documents long, ids long).
    """
    spark = docs.sparkSession
    batches_of(spark, ENCODED_ROWS)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer, words=False)
        fs, folder = _open(path)
        part, made = TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        keys: list[int | None] = []
        counts: list[int] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal made, held
            name = f"part-{part:06d}-{made:06d}.dac"
            passing = f"{folder}/.{name}.{uuid.uuid4().hex}"
            raw = b"".join(parts)
            parts.clear()
            with fs.open_output_stream(passing) as f:
                f.write(write_shard(keys, counts, np.frombuffer(raw, "<u4")))
            fs.move(passing, f"{folder}/{name}")
            done = pa.record_batch([[name], [len(keys)], [held]], names=["file", "documents", "ids"])
            made, held = made + 1, 0
            keys.clear(), counts.clear()
            return done

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), encoder.ids(b.column(1)), strict=True):
                ids += end
                keys.append(key)
                counts.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
                if held >= shard_ids:
                    yield close()
        if keys:
            yield close()

    fs, folder = _open(path)
    fs.create_dir(folder, recursive=True)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = own.repartitionByRange(partitions_for(own), "id").sortWithinPartitions("id", "text")
    return stage(dealt.mapInArrow(run, "file string, documents long, ids long"), "dac-manifest")


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids array<long>]) of every document in the shards, read back.

    start counts the ids of all shards and documents before it. The running sum over the manifest is
    the only step in one task; it has one row per shard.
    """
    batches_of(spark)
    more = ", ids array<long>" if keep_ids else ""
    before = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    bases = manifest.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = Shard(content.as_py())
                bounds = shard.starts.tolist()
                every = shard.ids(0, shard.n).astype("<u4", copy=False)
                for k in range(0, len(shard.doc_ids), 4096):
                    spans = list(zip(bounds[k : k + 4096], bounds[k + 1 : k + 4097], strict=False))
                    found = [every[i:j] for i, j in spans]
                    columns = [
                        pa.array(shard.doc_ids[k : k + len(spans)], pa.int64()),
                        pa.array([base + i for i, _ in spans], pa.int64()),
                        pa.array([j - i for i, j in spans], pa.int64()),
                        pa.array([zlib.crc32(x) for x in found], pa.int64()),
                    ]
                    if keep_ids:
                        columns.append(pa.array([x.tolist() for x in found], pa.list_(pa.int64())))
                    yield pa.record_batch(columns, names=["id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = f"id long, start long, n_tokens long, ids_crc32 long{more}"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    # each shard is a few MB; the manifest side is a row a shard
    return named.join(bases, "file").select("base", "content").mapInArrow(run, schema)
