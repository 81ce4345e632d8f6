"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and its deviation.  For two vectors and
segments of length n_s the squared distance is at least

    sum over s of n_s * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)

and with the norms known that bounds the inner product from above by
sum n_s * (mean_q * mean_x + dev_q * dev_x).  Each resolution is a short inner product, so a
block of candidates is bounded for a block of queries by one small matrix product.

1. Candidates are placed in blocks by the order of their first coarse mean, so that like
   vectors share a block; each block keeps the range of its rows' coarse features.
2. The middle block gives every query a floor: its k-th best score there, known to all others.
3. A query goes on only to the blocks whose range lets a score reach its floor; blocks
   that no query reaches are not sent anywhere.
4. In a cell of queries and candidates, pairs drop out from coarse to fine where the bound is
   below the floor; finer bounds are computed for what is left, pair by pair, or by
   one matrix product where that is cheaper.  Survivors get exact scores, again either way.

Each cell is of bounded size and hands on at most k rows a query; the k best of all cells are
merged.  On vectors like noise the bounds hold but leave nearly all pairs alive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.operators.ordered import running_totals
from arborlake.plans.stage import materialise


@dataclass(frozen=True)
class TopK:
    """``levels``: segments at each resolution, coarse to fine.  ``candidates`` and
    ``queries``: rows of a block; ``least_blocks``: candidate blocks at least.
    ``broadcast_blocks``: up to so many blocks their ranges are sent to the executors; beyond
    that no block is skipped whole, which changes no result."""

    k: int = 5
    levels: tuple[int, ...] = (4, 16)
    candidates: int = 4096
    queries: int = 2048
    least_blocks: int = 24
    broadcast_blocks: int = 50_000


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(n_s) * mean and sqrt(n_s) * deviation of every segment; not finite where
    squares overflow."""
    d = x.shape[1]
    edges = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
    n = np.diff(edges)
    with np.errstate(over="ignore", invalid="ignore"):
        s = np.add.reduceat(x, edges[:-1], axis=1)
        q = np.add.reduceat(x * x, edges[:-1], axis=1)
        mean = s / n
        dev = np.sqrt(np.maximum(q / n - mean * mean, 0))
    return np.concatenate([mean * np.sqrt(n), dev * np.sqrt(n)], axis=1)


def _open(bound: np.ndarray) -> np.ndarray:
    """Bounds of vectors so large that squares overflow exclude nothing."""
    return np.where(np.isfinite(bound), bound, np.inf)


def _whole(q: np.ndarray, x: np.ndarray) -> bool:
    """Inner products and their partial sums are whole numbers that doubles hold exactly."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0**53


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows of whole numbers; exact, in Python integers where
    doubles would round; beyond 64 bits they stop at the ends of the range."""
    if not len(q):
        return np.zeros(0, dtype=np.int64)
    if _whole(q, x):
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    top = (1 << 63) - 1
    return np.array([max(-top - 1, min(top, sum(int(a) * int(b) for a, b in zip(r, s)))) for r, s in zip(q.tolist(), x.tolist())], dtype=np.int64)


def _kth(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """k-th best score of each row over distinct ids; -inf with fewer."""
    order = np.lexsort((-score, ids), axis=1)
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    score[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    return np.sort(score, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(score), -np.inf)


def _pairs(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray, f, step: int = 200_000) -> np.ndarray:
    return np.concatenate([f(q[r[i : i + step]], x[c[i : i + step]]) for i in range(0, max(len(r), 1), step)])


def best_of_block(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, xid: np.ndarray, x: np.ndarray, p: TopK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the candidates of the block with its k best ids there, as far as they
    reach ``floor``: query row, candidate row, score."""
    k = p.k
    size_q, size_x = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    bound = _open(segment_features(q, p.levels[0]) @ segment_features(x, p.levels[0]).T + _slack(size_q[:, None] * size_x[None, :]))
    bound[qid[:, None] == xid[None, :]] = -np.inf
    # The candidates with the largest coarse bounds raise the floor.
    m = min(k + 3, len(xid))
    first = np.argpartition(-bound, m - 1, axis=1)[:, :m]
    rows = np.repeat(np.arange(len(qid)), m)
    score = exact_scores(q[rows], x[first.ravel()]).astype(np.float64).reshape(len(qid), m)
    score[np.isneginf(np.take_along_axis(bound, first, 1))] = -np.inf
    floor = np.maximum(floor, _kth(score, xid[first], k))
    r, c = np.nonzero(~np.isneginf(bound) & (bound >= floor[:, None]))
    whole = len(qid) * len(xid)
    for segments in p.levels[1:]:
        fq, fx = segment_features(q, segments), segment_features(x, segments)
        fine = (fq @ fx.T)[r, c] if len(r) * 10 > whole else _pairs(fq, fx, r, c, lambda a, b: np.einsum("ij,ij->i", a, b))
        keep = _open(fine + _slack(size_q[r] * size_x[c])) >= floor[r]
        r, c = r[keep], c[keep]
    s = (q @ x.T)[r, c].astype(np.int64) if len(r) * 10 > whole and _whole(q, x) else _pairs(q, x, r, c, exact_scores)
    keep = s >= floor[r]
    r, c, s = r[keep], c[keep], s[keep]
    order = np.lexsort((-s, xid[c], r))
    r, c, s = r[order], c[order], s[order]
    new = np.append(True, (r[1:] != r[:-1]) | (xid[c][1:] != xid[c][:-1]))[: len(r)]  # an id's best vector
    r, c, s = r[new], c[new], s[new]
    order = np.lexsort((xid[c], -s, r))
    r, c, s = r[order], c[order], s[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(qid)))[r] < k
    return r[keep], c[keep], s[keep]


def _slack(norms: np.ndarray) -> np.ndarray:
    """Rounding of the bounds."""
    return 1e-9 * norms + 1e-6


def block_bounds(f: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries (rows of features) with any row of each block."""
    return np.maximum(f, 0) @ hi.T + np.minimum(f, 0) @ lo.T


def top_k(vectors: DataFrame, is_query: Column, p: TopK = TopK(), scale: float = 256.0) -> DataFrame:
    """vectors (vec_id, embedding): for each row with ``is_query`` the k best inner products
    of floor(scale * component) with all other ids: query_id, rank, vec_id, score.

    Rows with a null id, a null vector, no component, or a component that is null or not
    finite, before or after scaling, take no part; vectors of different lengths have no score;
    a repeated row (same id and vector) counts once; rows that share an id are never each
    other's candidates, and of an id's several vectors the best score holds; ties go to the
    smaller id; scores beyond 64 bits stop at the ends of the range."""
    spark = vectors.sparkSession
    big = F.transform(F.col("embedding").cast("array<double>"), lambda e: e * F.lit(scale))
    fine = F.forall(big, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where("vec_id is not null and embedding is not null").where((F.size("embedding") > 0) & fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(big, lambda e: F.when(F.abs(e) < 9e18, F.floor(e).cast("double")).otherwise(e)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.groupBy("vec_id", "v").agg(F.max("q").alias("q")).withColumn("dim", F.size("v"))
    head = F.slice("v", 1, F.greatest(F.floor(F.col("dim") / p.levels[0]).cast("int"), F.lit(1)))
    lead = F.aggregate(head, F.lit(0.0), lambda a, e: a + e / F.size(head))
    rows = materialise(running_totals(rows.withColumn("lead", lead), [F.col("dim"), F.col("lead"), F.col("vec_id"), F.xxhash64("v")]), "topk_rows")
    size = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).first()
    nx = max(p.least_blocks, -(-size["n"] // p.candidates))
    per = max(1, -(-size["n"] // nx))
    nq = max(1, -(-size["nq"] // p.queries))
    x = rows.select("vec_id", "v", "dim", F.floor(F.col("row_no") / per).cast("int").alias("xb"))
    q = rows.where("q").select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(nq)).cast("int").alias("qb"))

    def cell(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        qid, xid = qs["vec_id"].to_numpy(np.int64), xs["vec_id"].to_numpy(np.int64)
        r, c, s = best_of_block(qid, np.stack(qs["v"].to_numpy()), qs["floor"].to_numpy(np.float64), xid, np.stack(xs["v"].to_numpy()), p)
        return pd.DataFrame({"query_id": qid[r], "vec_id": xid[c], "score": s})

    def meet(qs: DataFrame, xs: DataFrame) -> DataFrame:
        key = ["dim", "xb", "qb"]
        return qs.groupBy(*key).cogroup(xs.groupBy(*key)).applyInPandas(cell, "query_id long, vec_id long, score long")

    # The middle block gives the floors.
    middle = F.lit(nx // 2)
    every = F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb")
    first = materialise(meet(q.withColumn("xb", middle).withColumn("floor", F.lit(float("-inf"))), x.where(F.col("xb") == middle).select("*", every)), "topk_first")
    best = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    floors = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("m")).where(F.col("n") >= p.k).select("query_id", F.col("m").cast("double").alias("floor"))
    q = q.join(floors, q["vec_id"] == floors["query_id"], "left").select("vec_id", "v", "dim", "qb", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

    # A query goes to the blocks that its floor lets it reach.  The last feature is the norm.
    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (dim, xb), g in pdf.groupby(["dim", "xb"]):
                v = np.stack(g["v"].to_numpy())
                f = np.c_[segment_features(v, p.levels[0]), np.sqrt((v * v).sum(axis=1))]
                yield pd.DataFrame({"dim": dim, "xb": xb, "i": range(f.shape[1]), "lo": f.min(axis=0), "hi": f.max(axis=0)})

    own = x.where(F.col("xb") != middle).mapInPandas(ranges, "dim int, xb int, i int, lo double, hi double")
    own = materialise(own.groupBy("dim", "xb", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "topk_blocks")
    if nx <= p.broadcast_blocks:
        table = {}
        for dim, g in own.orderBy("dim", "xb", "i").toPandas().groupby("dim"):
            blocks = g["xb"].unique()
            lo, hi = (g[c].to_numpy().reshape(len(blocks), -1) for c in ("lo", "hi"))
            table[dim] = (blocks.astype(np.int32), lo[:, :-1], hi[:, :-1], hi[:, -1])
        shared = spark.sparkContext.broadcast(table)

        def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = pd.Series([np.zeros(0, np.int32)] * len(pdf), index=pdf.index, dtype=object)
                for dim, g in pdf.groupby("dim"):
                    if dim in shared.value:
                        xb, lo, hi, most = shared.value[dim]
                        v = np.stack(g["v"].to_numpy())
                        ok = _open(block_bounds(segment_features(v, p.levels[0]), lo, hi) + _slack(np.sqrt((v * v).sum(axis=1))[:, None] * most)) >= g["floor"].to_numpy()[:, None]
                        out[g.index] = [xb[o] for o in ok]
                yield pdf.assign(xbs=out)

        q = q.mapInPandas(reach, "vec_id long, v array<double>, dim int, qb int, floor double, xbs array<int>")
        q = materialise(q.select("vec_id", "v", "dim", "qb", "floor", F.explode("xbs").alias("xb")), "topk_queries")
    else:
        q = materialise(q.join(own.where("i = 0").select("dim", "xb"), "dim").select("vec_id", "v", "dim", "qb", "floor", "xb"), "topk_queries")
    cells = materialise(q.select("dim", "xb", "qb").distinct(), "topk_cells")
    met = first.unionAll(meet(q, x.join(cells, ["dim", "xb"]).select("vec_id", "v", "dim", "xb", "qb")))
    # A repeated id may meet a query with several vectors: the best one holds.
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB.
ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(256 * c::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, max(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT) AS score
  FROM e q JOIN e x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
