"""SimHash near-duplicates through pivot distance tables.

Fingerprints are 64-bit SimHashes of word shingles. Every distinct fingerprint gets its Hamming
distances to fixed reference fingerprints (the pivots). By the triangle inequality two fingerprints
within r bits differ by at most r in every one of these coordinates, so a candidate pair whose
largest coordinate difference exceeds r is discarded, and only survivors are compared bit by bit.

Candidates come from buckets, never from all pairs: of four 16-bit blocks, two fingerprints that
differ in at most two bits share at least two blocks, so they meet in one of six buckets of 32 equal
bits. A bucket above a bound is not paired at all: its fingerprints are linked through the words one
bit away from them (two fingerprints are within two bits exactly if they share such a word), which
costs 65 rows a fingerprint however large the bucket is. Both ways are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import batches_of, stage
from . import similar
from .components import components
from .shingles import hashes, majority
from .workers import tidy

#: The differing bits up to which fingerprints link.
RADIUS = 2
#: Reference fingerprints.
PIVOTS = tuple(int.from_bytes(hashlib.blake2b(b"pivot-%d" % i, digest_size=8).digest(), "big", signed=True) for i in range(16))
#: Fingerprints up to which a bucket is paired; larger ones take the way through neighbouring words.
BUCKET = 128


def fingerprint(text: bytes | None, words: int = similar.WORDS) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text (``shingles.hashes``, repeats included); 0 without words."""
    return majority(hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = similar.WORDS) -> DataFrame:
    """(id, fp long, text_hash long) for each row; fp holds the fingerprint's bits."""
    batches_of(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(values.view(np.int64)), b.column(2)], names=["id", "fp", "text_hash"])

    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("binary").alias("t"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    ).mapInArrow(run, "id long, fp long, text_hash long")


def _blocks(fp: F.Column) -> list[F.Column]:
    part = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return [
        F.lit(k << 32).bitwiseOR(F.shiftleft(part[i], 16)).bitwiseOR(part[j])
        for k, (i, j) in enumerate(combinations(range(4), 2))
    ]


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect fingerprints (column fp, distinct) within two bits.

    Every pair within two bits is connected: directly if it meets in a bucket of at most ``bucket``
    fingerprints, else through the smallest fingerprint that shares a neighbouring word.
    """
    table = distinct.select(
        "fp", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in PIVOTS]).alias("d")
    )
    keyed = table.select("fp", "d", F.explode(F.array(*_blocks(F.col("fp")))).alias("k"))
    sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = stage(keyed.join(sizes, "k"), "pivot-buckets")
    light = sized.where(F.col("n") <= bucket)
    a = light.select("k", F.col("fp").alias("u"), F.col("d").alias("du"))
    b = light.select("k", F.col("fp").alias("v"), F.col("d").alias("dv"))
    near = F.lit(True)
    for i in range(len(PIVOTS)):
        near = near & (F.abs(F.col("du")[i] - F.col("dv")[i]) <= RADIUS)
    exact = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    pairs = a.join(b, (a["k"] == b["k"]) & (F.col("u") < F.col("v")) & near & exact).select("u", "v")

    heavy = sized.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(np.uint64(1 << i).astype(np.int64).item())) for i in range(64)])
    around = heavy.select("fp", F.explode(flips).alias("w"))
    centre = around.groupBy("w").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "m")
    through = around.join(centre, "w").where("fp <> m").select(F.col("m").alias("u"), F.col("fp").alias("v"))
    return pairs.unionByName(through).distinct()


def _labels(distinct: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """(node, component_id): the smallest first_id of each component of ``distinct`` (node, first_id), staged."""
    roots = components(links)
    rooted = distinct.join(roots, distinct[node] == roots["node"], "left").select(
        distinct[node], "first_id", F.coalesce("root", distinct[node]).alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return stage(rooted.join(smallest, "root").select(node, "component_id"), "labels")


def _meetings(prints: DataFrame) -> DataFrame:
    """Pairs of keys (u, v) to compare, from (key, fp): one of equal fingerprints, and those that link."""
    distinct = stage(prints.groupBy("fp").agg(F.min("key").alias("u"), F.max("key").alias("v")), "distinct-fingerprints")
    edges = stage(links(distinct.select("fp")), "fingerprint-links")
    first, second = (distinct.select(F.col("fp").alias(k), F.col("u").alias(f"key_{k}")) for k in "uv")
    linked = edges.join(first, "u").join(second, "v").select(F.col("key_u").alias("u"), F.col("key_v").alias("v"))
    return distinct.where("u <> v").select("u", "v").unionByName(linked)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = similar.WORDS,
    least: tuple[int, int] | None = similar.LEAST,
) -> DataFrame:
    """One row per input row: (id, fp, text_hash, component_id).

    least: texts link if the Jaccard coefficient of their shingle sets is that fraction or more.
    Fingerprints within two bits meet first, and their texts are compared; since similar texts often
    differ in more bits, ``similar`` then finds all links that are left, so none is lost. None: texts
    link if their fingerprints are within two bits, and nothing else counts.

    component_id is the smallest id reachable through links, the row's own included. Null texts and
    texts without words have fingerprint zero and link with one another (with ``least`` None like any
    other fingerprint). Rows with a null id take part and get their component's smallest id, which is
    null if no member has one. Repeated rows stay. Other columns are not looked at.
    """
    if least is None:
        prints = stage(fingerprints(docs, id_col, text_col, words), "fingerprints", compact=True)
        distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct-fingerprints")
        labels = _labels(distinct, "fp", links(distinct.select("fp")))
        return prints.join(labels, "fp").select("id", "fp", "text_hash", "component_id")
    found = similar.groups(docs, id_col, text_col, words, least, _meetings)
    sets = found.groupBy("key", "group").agg(F.min("id").alias("i"))
    smallest = sets.groupBy("group").agg(F.min("i").alias("component_id"))
    labels = stage(sets.join(smallest, "group").select("key", "component_id"), "labels")
    return found.join(labels, "key").select("id", "fp", "text_hash", "component_id")


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = similar.WORDS,
    least: tuple[int, int] = similar.LEAST,
) -> DataFrame:
    """Keep one document of each group of ``near_duplicates``.

    The one with the smallest id stays (then the smallest text hash). Returns the columns of ``docs``.
    Documents without an id are kept only where no member of their group has one. Of fully repeated
    rows one stays. Ids only choose which member stays: different groups may hold the same id.
    """
    found = similar.groups(docs, id_col, text_col, words, least, _meetings)
    order = F.struct(F.col("id").isNull().alias("n"), "id", "text_hash")
    sets = found.groupBy("key", "group").agg(F.min(order).alias("k"))
    best = sets.groupBy("group").agg(F.min("k").alias("k"))
    best = stage(sets.select("key", "group").join(best, "group").select("key", F.col("k.id").alias("best"), F.col("k.text_hash").alias("hash")), "best-of-groups")
    kept = F.col("best").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash"))
    marked = found.join(best, "key").select(F.col("id").alias("_copy_id"), F.col("text_hash").alias("_copy_hash"), kept.alias("_kept"))
    marked = stage(marked, "marked")  # a plain join, so that a large group's rows are split over tasks
    copies = marked.groupBy("_copy_id", "_copy_hash", "_kept").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or not _kept")
    copies = stage(copies.drop("c"), "copies")
    own = docs.withColumn("_own_hash", F.xxhash64(F.col(text_col)))
    same = (F.col("_copy_hash") == F.col("_own_hash")) & F.col("_copy_id").eqNullSafe(own[id_col].cast("long"))
    repeated = similar.by_keys(own, stage(copies.where("_kept"), "repeated"), same, "left_semi").dropDuplicates(["_own_hash", id_col])
    return similar.by_keys(own, copies, same, "left_anti").unionByName(repeated).drop("_own_hash")
