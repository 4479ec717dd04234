"""Connected components of a large edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stage


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    """Count and two order-free hashes: equal for equal edge sets."""
    r = edges.agg(
        F.count(F.lit(1)),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        F.bit_xor(F.xxhash64("v", "u")),
    ).first()
    return int(r[0]), int(r[1] or 0), int(r[2] or 0)


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of ``edges`` (u long, v long) with the smallest node of their component.

    Returns (node, root), one row per node that has an edge to another node. Self-loops and repeated
    or reversed edges change nothing; nulls in u or v drop the edge; no edges give no rows.

    Each round links all larger neighbours of a node to its smallest neighbour, then the smaller
    ones. Minima are aggregated before the shuffle and joined back, so the neighbours of one node are
    never gathered in a task (the join's hot keys are left to adaptive splitting). Rounds grow with
    the logarithm of the component's size. Each round is written to the shared folder, and the driver
    sees a count and two hashes of it.
    """
    e = stage(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = stage(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        old, e = e, stage(small, "small-star")
        for gone in (old, large):
            discard(gone)
        after = _mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
