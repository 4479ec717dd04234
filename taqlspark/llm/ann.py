"""Exact nearest neighbours by a block matrix join of int8 tiles with quantisation error bounds.

Vectors are cut into blocks; each tile pairs one block of queries with one run of candidate blocks.
Within a tile both sides are rounded to int8 steps of their own scale. The product of the rounded
vectors is off by at most |eq||y'| + |x'||ey| + |eq||ey| (Cauchy-Schwarz, with the norms of what
rounding took away), so every candidate whose upper bound is below the k-th largest lower bound can
go. Survivors are computed again from the original values in double precision, and a heap of k per
query takes them in. A last step merges the heaps of all tiles of a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import batches_of, stage

#: Neighbours per query; vectors in a block of queries and in a run of candidates.
K, QUERIES, CANDIDATES = 20, 512, 8192

_STEP = 1024


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 steps (as float32, in which their products add up exactly), scale, norms of the rounded vectors and of the rest."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    steps = np.rint(x / scale[:, None])
    back = steps * scale[:, None]
    rest = np.linalg.norm(x - back, axis=1)
    return steps.astype(np.float32), scale, np.linalg.norm(back, axis=1), rest * (1 + 1e-9) + 1e-300


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last in double precision."""
    total = np.zeros(len(b))
    for d in range(len(a)):
        total += a[d] * b[:, d]
    return total


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, heaps: list[list[tuple[float, int]]]) -> None:
    """Put the k nearest of the candidates into each query's heap of (score, -id)."""
    if not len(qid) or not len(cid):
        return
    qs, q_scale, q_norm, q_rest = rounded(q)
    for s in range(0, len(cid), _STEP):
        ids, part = cid[s : s + _STEP], c[s : s + _STEP]
        cs, c_scale, c_norm, c_rest = rounded(part)
        # |steps| <= 127: float32 adds up to 2**24 / 127**2 = 1040 components exactly; wider ones go in slices
        near = np.zeros((len(qs), len(cs)))
        for d in range(0, qs.shape[1], 1024):
            near += qs[:, d : d + 1024] @ cs[:, d : d + 1024].T
        near *= q_scale[:, None] * c_scale[None, :]
        off = q_rest[:, None] * c_norm[None, :] + q_norm[:, None] * c_rest[None, :] + q_rest[:, None] * c_rest[None, :]
        off += 1e-12 * (1 + np.abs(near))
        low, high = near - off, near + off
        for i in range(len(qid)):
            heap = heaps[i]
            own = ids != qid[i]
            row = low[i][own]
            # one more than k: nothing is lost where a bound and an exact score tie
            floor = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            if len(heap) == k:
                floor = max(floor, heap[0][0])
            at = np.flatnonzero(own & (high[i] >= floor))
            for score, vec in zip(products(q[i], part[at]).tolist(), ids[at].tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_modulus: int = 20,
    k: int = K,
    queries_per_block: int = QUERIES,
    candidates_per_run: int = CANDIDATES,
) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): the k rows nearest each query row by inner product.

    Queries are the rows whose id is divisible by ``query_modulus``; candidates are all rows but the
    query's own. Rows with a null id take no part, nor do vectors that are null, empty, all zero or
    that hold null or non-finite components. Vectors of different lengths are never compared. Of
    repeated ids every copy is a row of its own as a candidate; a query id is asked once (with its
    largest vector in array order). Ties go to the smaller id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    batches_of(spark, 4096)
    values = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    big = F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), values.alias("v")).where(
        F.col("id").isNotNull()
        & F.col("v").isNotNull()
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    rows = stage(rows.withColumn("dim", F.size("v")), "vectors")
    q = rows.where(F.col("id") % query_modulus == 0).groupBy("id", "dim").agg(F.max("v").alias("v"))
    q = q.groupBy("id").agg(F.max(F.struct("dim", "v")).alias("x")).select("id", F.col("x.dim").alias("dim"), F.col("x.v").alias("v"))
    q = stage(q, "queries")
    n_q, n_c = q.count(), rows.count()
    q_blocks, c_runs = max(1, -(-n_q // queries_per_block)), max(1, -(-n_c // candidates_per_run))
    # a tile is (dim, query block, candidate run); both sides are hashed, so a tile's size is bounded by its counts
    left = q.select(
        "dim", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("qb"), "id", "v"
    ).withColumn("cr", F.explode(F.sequence(F.lit(0), F.lit(c_runs - 1))))
    # repeated ids and vectors are spread too
    right = rows.select(
        "dim", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(c_runs)).cast("int").alias("cr"), "id", "v"
    ).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("id")
        qid = a["id"].to_numpy()
        heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
        if len(a) and len(b):
            tile(qid, np.stack(a["v"].to_list()), b["id"].to_numpy(), np.stack(b["v"].to_list()), k, heaps)
        found = [(x, -y, s) for x, heap in zip(qid.tolist(), heaps, strict=True) for s, y in heap]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["dim", "qb", "cr"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
