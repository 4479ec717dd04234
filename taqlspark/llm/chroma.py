"""Chroma audio fingerprints: pitch-class frames, integral-image filters, packed integers, alignment.

A recording's spectrum is folded into 12 pitch classes per frame. Sixteen filters compare the energy
of two areas of the frame-by-class image; each area's sum takes four reads of the integral image.
A filter's value is quantised to two Gray-coded bits, so each place gives one 32-bit integer.

Two recordings are aligned through the offsets between equal integers: the offset that most of them
agree on is tried, and bit errors over the overlap decide. Recordings with equal fingerprints form a
class and are compared once. Query classes meet all classes in blocks of bounded size.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import batches_of, stage

#: Samples a second, samples of a frame and between frames, and the band that is folded.
RATE, FRAME, HOP, BAND = 4000, 1024, 500, (100.0, 1900.0)
CLASSES, FILTERS = 12, 16
#: Share of differing bits up to which an overlap of at least OVERLAP integers is a match.
BIT_ERRORS, OVERLAP = 0.15, 16
#: Query classes in a block, classes in a run, and pairs of equal integers held at once.
QUERIES, CANDIDATES, HELD = 256, 4096, 2_000_000


def filters() -> list[tuple[int, int, int, int, int]]:
    """(kind, first class, classes, frames, shift) of each filter, drawn from a hash of its number.

    Kinds: 0 upper against lower half, 1 left against right half, 2 diagonal against other quarters,
    3 middle against outer thirds of the classes.
    """
    out = []
    for i in range(FILTERS):
        d = hashlib.blake2b(b"chroma-filter-%d" % i, digest_size=8).digest()
        kind = i % 4
        height = (2, 4, 6)[d[0] % 3] if kind != 3 else (3, 6, 9)[d[0] % 3]
        out.append((kind, d[1] % (CLASSES - height + 1), height, (4, 6, 8)[d[2] % 3], 0))
    return out


WIDEST = 8
_FILTERS = filters()
#: Gray codes of the four steps, and the borders between them on the log ratio of two areas.
_GRAY, _STEPS = np.array([0, 1, 3, 2], np.uint32), np.array([-0.25, 0.0, 0.25])


def chroma(pcm: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12) pitch-class energies of mono samples, each frame scaled to length one; silence stays zero."""
    n = 1 + (len(pcm) - FRAME) // HOP if len(pcm) >= FRAME else 0
    if n <= 0:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float64), FRAME)[::HOP][:n]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    used = (hertz >= BAND[0]) & (hertz <= BAND[1])
    pitch = np.rint(12 * np.log2(hertz[used] / 440.0)).astype(int) % CLASSES
    fold = np.zeros((used.sum(), CLASSES))
    fold[np.arange(len(pitch)), pitch] = 1.0
    out = power[:, used] @ fold
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)


def pack(image: np.ndarray) -> np.ndarray:
    """Unsigned 32-bit integers of a frame-by-class image; none if it is shorter than the widest filter."""
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, CLASSES + 1))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return total[at + x1, y1] - total[at + x0, y1] - total[at + x1, y0] + total[at + x0, y0]

    out = np.zeros(n, np.uint32)
    for k, (kind, y, h, w, x) in enumerate(_FILTERS):
        whole = area(x, x + w, y, y + h)
        if kind == 0:
            a = area(x, x + w, y, y + h // 2)
        elif kind == 1:
            a = area(x, x + w // 2, y, y + h)
        elif kind == 2:
            a = area(x, x + w // 2, y, y + h // 2) + area(x + w // 2, x + w, y + h // 2, y + h)
        else:
            a = area(x, x + w, y + h // 3, y + 2 * h // 3)
        value = np.round(np.log1p(a) - np.log1p(whole - a), 9)
        out |= _GRAY[np.searchsorted(_STEPS, value, side="right")] << np.uint32(2 * k)
    return out


def fingerprint(pcm: bytes | None) -> np.ndarray:
    """Packed integers of 16-bit little-endian mono samples; none for null, empty or very short audio. A half sample at the end is left out."""
    if not pcm:
        return np.zeros(0, np.uint32)
    return pack(chroma(np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2")))


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int] | None:
    """(offset, bit errors, bits) of the best alignment of two fingerprints, or None if they don't match.

    offset: the place in b minus the place in a. Offsets of equal integers are counted; the most
    frequent (ties: the one nearest to zero, then the smaller) is tried.
    """
    order = np.argsort(b, kind="stable")
    i, j = _equal(a, b[order], order)
    return _best(a, b, j - i) if len(i) else None


def _equal(a: np.ndarray, b: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b (b sorted, its places in ``where``) of all pairs of equal integers."""
    lo, hi = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(a)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return i, where[k]


def _best(a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> tuple[int, int, int] | None:
    values, counts = np.unique(offsets, return_counts=True)
    best = min(zip((-counts).tolist(), np.abs(values).tolist(), values.tolist(), strict=True))[2]
    lo, hi = max(0, -best), min(len(a), len(b) - best)
    if hi - lo < OVERLAP:
        return None
    errors = int(np.bitwise_count(a[lo:hi] ^ b[lo + best : hi + best]).sum())
    bits = 32 * (hi - lo)
    return (best, errors, bits) if errors <= BIT_ERRORS * bits else None


def fingerprints(recordings: DataFrame, id_col: str, pcm: F.Column, render=None) -> DataFrame:  # noqa: ANN001
    """(id, fp binary: little-endian u32) of each row; ``render`` turns a cell into samples' bytes first."""
    batches_of(recordings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(1).to_pylist()
            out = [fingerprint(render(c) if render else c).astype("<u4").tobytes() for c in cells]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["id", "fp"])

    return recordings.select(F.col(id_col).cast("long").alias("id"), pcm.alias("c")).mapInArrow(run, "id long, fp binary")


def match(recordings: DataFrame, id_col: str, pcm: F.Column, query_modulus: int = 20, render=None, queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:  # noqa: ANN001
    """Classes of equal fingerprints, and all classes that each query class aligns with.

    Rows of kind ``member``: id and its class_id (the smallest id with the same fingerprint); null ids
    too, and where a whole class has none, class_id is null. Rows of kind ``match``: id, the smallest
    id of a class that holds a query (an id divisible by ``query_modulus``); class_id, another class;
    the offset, bit errors and bits of their alignment; n_members of that class. Recordings too short
    for a fingerprint are members of one class and match nothing. Repeated rows are members each.
    Other columns are not read. An empty table gives no rows.
    """
    prints = stage(fingerprints(recordings, id_col, pcm, render), "chroma-prints", compact=True)
    classes = stage(
        prints.groupBy("fp").agg(
            F.min("id").alias("class_id"),
            F.count(F.lit(1)).alias("n"),
            F.max((F.col("id") % query_modulus == 0).cast("int")).alias("asked"),
        ),
        "chroma-classes",
    )
    # a stage of its own, in which Spark can split the hot group of a fingerprint
    members = prints.join(classes.select("fp", "class_id"), "fp").select(F.lit("member").alias("kind"), "id", "class_id")
    members = stage(members, "chroma-members")
    used = classes.where((F.length("fp") > 0) & F.col("class_id").isNotNull())
    n_q, n_c = used.where("asked = 1").count(), used.count()
    q_blocks, c_runs = max(1, -(-n_q // queries)), max(1, -(-n_c // candidates))
    left = used.where("asked = 1").select(
        F.pmod(F.xxhash64("class_id"), F.lit(q_blocks)).cast("int").alias("qb"), F.col("class_id").alias("q_id"), F.col("fp").alias("q_fp"), F.explode(F.sequence(F.lit(0), F.lit(c_runs - 1))).alias("cr")
    )
    right = used.select(
        F.pmod(F.xxhash64("class_id"), F.lit(c_runs)).cast("int").alias("cr"), "class_id", "fp", "n", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb")
    )

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            qs = [np.frombuffer(x, "<u4") for x in a["q_fp"]]
            cs = [np.frombuffer(x, "<u4") for x in b["fp"]]
            flat = np.concatenate(cs)
            row = np.repeat(np.arange(len(cs)), [len(x) for x in cs])
            place = np.concatenate([np.arange(len(x)) for x in cs])
            order = np.argsort(flat, kind="stable")
            flat, row, place = flat[order], row[order], place[order]
            for q, q_id in zip(qs, a["q_id"].tolist(), strict=True):
                lo, hi = np.searchsorted(flat, q, "left"), np.searchsorted(flat, q, "right")
                # each distinct (row, offset) is counted; at most HELD pairs are held before they are
                counts = np.zeros((0, 3), np.int64)
                for s in _slices(hi - lo):
                    n = (hi - lo)[s]
                    i = np.repeat(np.arange(len(q))[s], n)
                    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[s], n)
                    pairs = np.stack([row[k], place[k] - i, np.ones(len(k), np.int64)], axis=1)
                    counts = _summed(np.concatenate([counts, pairs]))
                for c, offset in _tops(counts):
                    if (class_id := int(b["class_id"].iat[c])) != q_id and (found := _best(q, cs[c], np.array([offset]))):
                        out.append((q_id, class_id, *found, int(b["n"].iat[c])))
        return pd.DataFrame(out, columns=["id", "class_id", "offset", "bit_errors", "bits", "n_members"]).astype("int64")

    tiles = left.groupBy("qb", "cr").cogroup(right.groupBy("qb", "cr")).applyInPandas(
        run, "id long, class_id long, offset long, bit_errors long, bits long, n_members long"
    )
    return members.unionByName(tiles.withColumn("kind", F.lit("match")), allowMissingColumns=True)


def _slices(n: np.ndarray) -> Iterator[slice]:
    """Runs of at most HELD pairs (a single integer's pairs are never more than a run's integers)."""
    begin, held = 0, 0
    for i, x in enumerate(n.tolist()):
        if held and held + x > HELD:
            yield slice(begin, i)
            begin, held = i, 0
        held += x
    yield slice(begin, len(n))


def _summed(pairs: np.ndarray) -> np.ndarray:
    """Equal (row, offset) made one, with the sum of their counts."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    first = np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1))
    at = np.flatnonzero(first)
    return np.column_stack([pairs[at, :2], np.add.reduceat(pairs[:, 2], at)])


def _tops(counts: np.ndarray) -> list[tuple[int, int]]:
    """The most frequent offset of each row; ties as in ``align``."""
    if not len(counts):
        return []
    order = np.lexsort((counts[:, 1], np.abs(counts[:, 1]), -counts[:, 2], counts[:, 0]))
    rows = counts[order]
    first = np.append(True, rows[1:, 0] != rows[:-1, 0])
    return [(int(r), int(o)) for r, o, _ in rows[first]]


def render_vector(values: list[float | None] | None) -> bytes:
    """A vector played as notes, one per component, an eighth of a second each: 16-bit mono samples at RATE.

    The component's size chooses one of 24 semitones above 220 Hz. Null and non-finite components are
    silent, a null vector is no audio.
    """
    if not values:
        return b""
    x = np.array([np.nan if v is None else v for v in values], dtype=np.float64)
    good = np.isfinite(x)
    note = np.clip(np.floor((np.where(good, x, 0.0) + 0.4) * 30), 0, 23)
    t = np.arange(RATE // 8) / RATE
    tone = np.sin(2 * np.pi * (220.0 * 2 ** (note / 12))[:, None] * t) * good[:, None]
    return np.rint(tone.ravel() * 12_000).astype("<i2").tobytes()
