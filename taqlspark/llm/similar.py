"""Exact similarity of texts: the Jaccard coefficient of their sets of word shingles.

Two sets of a and b shingles with a coefficient of t or more share at least t * max(a, b) of them. So
whatever the order of all shingles, the first n - ceil(t * n) + 1 of each set (its prefix) have one in
common: pairs that meet in no prefix can't be similar, and no similar pair is lost. The order puts
shingles that a sample of the texts holds often last, so that prefixes hold rare ones; the sample
changes the work, never the result.

Texts that share a prefix shingle form a bucket, and buckets are never paired within themselves. A
round compares the members of each bucket with a few leaders; those that are similar are linked, and
the leaders, who have met everyone, leave. Pairs that links join already are never compared again, so
a family of copies, however large, costs about one comparison a member. Rounds go on with twice the
leaders until what is left, counted beforehand, is in proportion to the members: then all pairs that
no link joins are compared. Every pair with its first common shingle in a bucket is thus compared or
joined, and the groups are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import batches_of, discard, stage
from .components import components
from .shingles import hashes, majority
from .workers import tidy

#: Shingle length in words, and the least coefficient as a fraction.
WORDS, LEAST = 5, (4, 5)
#: One of so many texts is sampled for the order of shingles, which lists so many of them at most (16 bytes each are broadcast).
SHARE, LISTED = 4, 1_000_000
#: Leaders of a bucket in the first round.
LEADERS = 4
#: All pairs that are left are compared once there are at most so many a member.
LEFT = 128
#: Keys up to which the smaller side of a semi or anti join is sent to all tasks; beyond that both sides are shuffled.
SENT = 1_000_000


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The set of a UTF-8 text's shingles as sorted 64-bit hashes (``shingles.hashes``); empty without words."""
    return np.unique(hashes(text, words))


def _key(own: np.ndarray) -> int:
    """64 bits that name a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).astype(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(v) for v in values])), pa.int32()), pa.array(flat))


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a share of ``texts`` (t binary) holds three times or more, sorted, and their ranks by number."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.concatenate([*(shingles(t.as_py(), words) for t in b.column(0)), np.zeros(0, np.uint64)])
            yield pa.record_batch([pa.array(found.view(np.int64))], names=["s"])

    drawn = texts.select("t").where(F.pmod(F.xxhash64("t"), F.lit(SHARE)) == 0)
    often = drawn.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    often = stage(often.withColumn("size", F.floor(F.log2("n") * 4).cast("int")), "frequent-shingles", compact=True)
    listed, least = 0, None
    for size, count in sorted(((r[0], r[1]) for r in often.groupBy("size").count().collect()), reverse=True):
        listed += count
        if listed > LISTED:
            break
        least = size
    chosen = (often.where(F.lit(False)) if least is None else often.where(F.col("size") >= least)).select("s", "n").toArrow()
    discard(often)
    found, number = (chosen[c].to_numpy().astype(np.int64) for c in ("s", "n"))
    found = found.view(np.uint64)
    ranks = np.empty(len(found), dtype=np.int64)
    ranks[np.lexsort((found, number))] = np.arange(1, len(found) + 1)
    order = np.argsort(found)
    return found[order], ranks[order]


def prefix(own: np.ndarray, common: np.ndarray, ranks: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """The first shingles of a set in the order of all: those not listed before listed ones, rare before frequent."""
    if not len(own):
        return own
    place = np.zeros(len(own), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        place = np.where(common[at] == own, ranks[at], 0)
    first = len(own) + (-len(own) * least[0]) // least[1] + 1
    return own[np.lexsort((own, place))[:first]]


def by_keys(rows: DataFrame, keys: DataFrame, on: str | F.Column, how: str) -> DataFrame:
    """A semi or anti join with a staged table of keys, which is sent to all tasks only while it is small."""
    return rows.join(F.broadcast(keys) if keys.count() <= SENT else keys, on, how)


class _Texts:
    """Texts of one call: their sets, prefixes and verified links.

    rows: one row per input row (id, text_hash, fp, key, n, firsts); once: one per different set.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, least: tuple[int, int]) -> None:
        if not 0 < least[0] <= least[1]:
            raise ValueError("the coefficient lies above 0 and up to 1")
        self.words, (self.num, self.den) = words, least
        spark = docs.sparkSession
        batches_of(spark)
        self.texts = docs.select(
            F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("binary").alias("t")
        )
        sent = spark.sparkContext.broadcast(_common(self.texts, words))

        @tidy
        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common, ranks = sent.value
            for b in batches:
                found = [hashes(t.as_py(), words) for t in b.column(2)]
                prints = pa.array(np.array([majority(h) for h in found], dtype=np.uint64).view(np.int64))
                sets = [np.unique(h) for h in found]
                keys, sizes = pa.array([_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())
                firsts = _lists([prefix(s, common, ranks, least) for s in sets])
                yield pa.record_batch(
                    [b.column(0), b.column(1), prints, keys, sizes, firsts], names=["id", "text_hash", "fp", "key", "n", "firsts"]
                )

        schema = "id long, text_hash long, fp long, key long, n int, firsts array<long>"
        self.rows = stage(self.texts.mapInArrow(prefixes, schema), "shingle-prefixes")
        first = self.rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "text_hash", "fp", "firsts")])
        self.once = stage(first, "different-sets")
        self.sets: DataFrame | None = None
        self.links: DataFrame | None = None

    def fits(self, n_u: F.Column, p_u: F.Column, n_v: F.Column, p_v: F.Column) -> F.Column:
        """Whether two sets of n shingles, the first common one at p (from 0) in each, may be similar."""
        n_u, n_v = n_u.cast("long"), n_v.cast("long")
        rest = F.least(n_u - p_u, n_v - p_v)
        return (F.least(n_u, n_v) * self.den >= F.greatest(n_u, n_v) * self.num) & (rest * (self.num + self.den) >= (n_u + n_v) * self.num)

    def _similar(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v: keys) that are similar, compared by prefixes and then by whole sets."""
        num, den = self.num, self.den
        pairs = stage(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "met-pairs")
        ends = stage(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "met-keys")
        short = stage(by_keys(self.once, ends, "key", "left_semi"), "met-prefixes")
        left, right = (short.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("firsts").alias(f"f{k}")) for k in "uv")
        total = F.col("nu").cast("long") + F.col("nv")
        # behind the end of one of the two prefixes there are at most that set's other shingles
        behind = F.floor(F.greatest("nu", "nv").cast("long") * num / F.lit(den)) + 1
        shared = F.size(F.array_intersect("fu", "fv")).cast("long")
        near = pairs.join(left, "u").join(right, "v").where((shared + behind) * (num + den) >= total * num).select("u", "v")
        near = stage(near, "near-pairs", compact=True)
        self._extend(near, short)
        left, right = (self.sets.select(F.col("key").alias(k), F.col("whole").alias(f"w{k}")) for k in "uv")
        total = F.size("wu").cast("long") + F.size("wv")
        shared = F.size(F.array_intersect("wu", "wv")).cast("long")
        found = stage(near.join(left, "u").join(right, "v").where(shared * (num + den) >= total * num).select("u", "v"), "links", compact=True)
        for gone in (pairs, ends, short, near):
            discard(gone)
        return found

    def _extend(self, near: DataFrame, short: DataFrame) -> None:
        """Sets of all texts in ``near`` that aren't held yet; short has their text hashes."""
        words = self.words

        @tidy
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [shingles(t.as_py(), words) for t in b.column(0)]
                yield pa.record_batch([pa.array([_key(s) for s in sets], pa.int64()), _lists(sets)], names=["key", "whole"])

        ends = near.select(F.explode(F.array("u", "v")).alias("key"))
        if self.sets is not None:
            ends = ends.join(self.sets.select("key"), "key", "left_anti")
        named = stage(short.select("key", "text_hash").join(ends, "key", "left_semi").select("text_hash"), "near-texts", compact=True)
        chosen = by_keys(self.texts.select("text_hash", "t"), named, "text_hash", "left_semi").dropDuplicates(["text_hash"])
        added = stage(chosen.select("t").mapInArrow(whole, "key long, whole array<long>"), "near-sets")
        self.sets = added if self.sets is None else self.sets.unionByName(added)
        discard(named)

    def link(self, pairs: DataFrame) -> None:
        """Add those pairs that are similar to the links."""
        found = self._similar(pairs)
        self.links = found if self.links is None else self.links.unionByName(found)

    def _grouped(self, rows: DataFrame) -> DataFrame:
        """Rows with a group (g) that links join their key to: the smallest key within two links."""
        both = self.links.unionByName(self.links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        one = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("g"))
        two = both.join(one.select(F.col("u").alias("v"), "g"), "v").groupBy(F.col("u").alias("key")).agg(F.min("g").alias("g"))
        two = stage(two, "joined")
        return rows.join(two, "key", "left").withColumn("g", F.coalesce("g", "key"))

    def _active(self, members: DataFrame) -> DataFrame:
        """Members (s, key, n, p, g) of buckets that hold more than one group."""
        members = members.select("s", "key", "n", "p", "g")
        buckets = members.groupBy("s").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("s")
        return stage(members.join(buckets, "s"), "buckets")

    def complete(self, first: DataFrame | None) -> None:
        """Link all similar pairs; those in ``first`` (u, v) are compared along with the first leaders."""
        members = self.once.select("key", "n", F.col("key").alias("g"), F.posexplode("firsts").alias("p", "s"))
        active, leaders = self._active(members), LEADERS
        while True:
            other = active.select("s", *[F.col(c).alias(f"{c}v") for c in ("key", "n", "p", "g")])
            meet = (F.col("g") != F.col("gv")) & self.fits(F.col("n"), F.col("p"), F.col("nv"), F.col("pv"))
            pairs = [F.col("key").alias("u"), F.col("keyv").alias("v")]
            if leaders > LEADERS:
                sizes = active.groupBy("s", "g").agg(F.count(F.lit(1)).alias("c")).groupBy("s").agg(F.sum("c").alias("c"), F.max(F.struct("c", "g")).alias("most"))
                left = (F.col("c") * (F.col("c") - F.col("most.c"))).cast("double")
                sizes = stage(sizes.select("s", "c", F.col("most.g").alias("most"), left.alias("left")), "bucket-sizes")
                members_left, pairs_left = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("left"), F.lit(0.0))).first()
                if pairs_left <= LEFT * members_left:
                    if members_left:  # a bucket's largest group never meets itself
                        few = active.join(sizes.select("s", "most"), "s").where("g <> most").drop("most")
                        self.link(few.join(other, "s").where(meet).select(*pairs))
                    discard(active)
                    return
                discard(sizes)
            slot = F.pmod(F.xxhash64("key", F.lit(leaders)), F.lit(leaders))
            # an original shares all its shingles with its copies, which have some of their own: those that share most lead
            shared = active.groupBy("key").agg(F.count(F.lit(1)).alias("shared"))
            order = F.struct((F.col("shared") / F.col("n")).alias("r"), "key")
            chosen = active.join(shared, "key").groupBy("s", slot.alias("slot")).agg(F.max(order).alias("most"))
            chosen = stage(chosen.select("s", F.col("most.key").alias("keyv")), "leaders", compact=True)
            met = active.join(other.join(chosen, ["s", "keyv"], "left_semi"), "s").where(meet).select(*pairs)
            self.link(met if first is None else met.unionByName(first))
            first = None
            gone = chosen.withColumnRenamed("keyv", "key")
            before, active = active, self._active(self._grouped(active.drop("g").join(gone, ["s", "key"], "left_anti")))
            for old in (before, chosen):
                discard(old)
            leaders *= 2

    def groups(self) -> DataFrame:
        """(id, text_hash, fp, key, group) of each input row."""
        discard(self.once)
        roots = components(self.links).withColumnRenamed("node", "key")
        rows = self.rows.select("id", "text_hash", "fp", "key").join(roots, "key", "left")
        return rows.select("id", "text_hash", "fp", "key", F.coalesce("root", "key").alias("group"))


def groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    least: tuple[int, int] = LEAST,
    first: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per input row: (id, text_hash, fp, key, group). Texts whose coefficient is ``least`` or more are linked.

    Rows are in one group exactly if links lead from one to the other. fp is the SimHash of the text's
    shingles, key names its set of them. Texts without words, nulls included, are equal. Ids are only
    passed on: null and repeated ones change no group. Shingles and sets are named by 64-bit hashes.
    first: makes pairs of keys (u, v) that are compared early from a staged table (key, fp) of the
    different sets; they change the work, not the result.
    """
    found = _Texts(docs, id_col, text_col, words, least)
    found.complete(None if first is None else first(found.once.select("key", "fp")))
    return found.groups()
