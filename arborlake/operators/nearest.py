"""Nearest neighbours whose cost does not depend on how crowded the points are.

A fixed cell holds any number of points; here the edge follows from the points: cells are
halved until the mean number of points in a point's own cell is small (``block_edge``), so all
cells together have about that many pairs a point, whatever the clusters.  Copies do not
crowd cells: of equal positions only the first ids can be neighbours, and each position is
asked for once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.plans.stage import discard, materialise

_Q, _P = ["_qx", "_qy", "_qz"], ["_px", "_py", "_pz"]
#: Rounds by blocks; positions left after them are joined to streamed points, and so few of
#: them compared with all points at once.
_BLOCK_ROUNDS, _SCAN = 2, 2_000


def finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose ``cols`` are all finite numbers."""
    for c in cols:
        df = df.where(F.abs(c) < float("inf"))
    return df


def block_edge(pts: DataFrame, xyz: list[str], most: float, levels: int = 60) -> float:
    """Edge of cubes in which a point shares its cube with ``most`` points in the mean, so
    with n points no cube holds more than the root of most * n."""
    box = pts.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(xyz) for k, f in (("l", F.min), ("h", F.max))]).first()
    n = box["n"]
    edge = max([box[f"h{i}"] - box[f"l{i}"] for i in range(len(xyz))], default=0.0) if n else 0.0
    if not edge > 0 or not math.isfinite(edge):
        return 1.0
    edge /= 2 ** max(0, int(math.log2(max(1.0, n / most)) / len(xyz)))
    for _ in range(levels):
        cells = pts.groupBy(*[F.floor(F.col(c) / edge).alias(f"c{i}") for i, c in enumerate(xyz)]).agg(F.count("*").alias("n"))
        if (cells.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0) <= most * n:
            break
        edge /= 2
    return edge


def k_least(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int, r2: float, block: int = 2_000_000) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each row of ``q`` the ids and squared distances of the k nearest rows of ``p`` no
    farther than the root of r2, nearest first, ties by id."""
    by = np.argsort(ids, kind="stable")
    p, ids = p[by], ids[by]
    who, far = [], []
    step = max(1, block // max(1, len(p)))
    for i in range(0, len(q), step):
        a = q[i : i + step]
        d2 = (a[:, None, 0] - p[None, :, 0]) ** 2
        for c in range(1, p.shape[1]):
            d2 += (a[:, None, c] - p[None, :, c]) ** 2
        bound = np.full(len(a), r2)
        if len(p) > k:
            bound = np.minimum(bound, np.partition(d2, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero(d2 <= bound[:, None])
        v = d2[row, col]
        order = np.lexsort((v, row))  # stable: ties stay in the order of ids
        row, col, v = row[order], col[order], v[order]
        ends = np.searchsorted(row, np.arange(len(a) + 1))
        for j in range(len(a)):
            s, e = ends[j], min(ends[j + 1], ends[j] + k)
            who.append(ids[col[s:e]])
            far.append(v[s:e])
    return who, far


def _cells(cols: list[str], edge: float) -> list[Column]:
    return [F.floor(F.col(c) / edge).cast("long").alias(f"_b{i}") for i, c in enumerate(cols)]


def _around(pts: DataFrame, cols: list[str], r: float, edge: float) -> DataFrame:
    """Each point in all cells within r of it."""
    for i, c in enumerate(cols):
        # A little more than r, so that rounding loses no one.
        lo, hi = F.col(c) - r * (1 + 1e-9) - 1e-12 * F.abs(c), F.col(c) + r * (1 + 1e-9) + 1e-12 * F.abs(c)
        pts = pts.withColumn(f"_b{i}", F.explode(F.sequence(F.floor(lo / edge).cast("long"), F.floor(hi / edge).cast("long"))))
    return pts


def _by_blocks(ask: DataFrame, pts: DataFrame, k: int, r: float, edge: float, p_id: str) -> DataFrame:
    n = len([c for c in ask.columns if c in _Q])
    q, p, keys = _Q[:n], _P[:n], [f"_b{i}" for i in range(n)]
    left = ask.select(*q, *_cells(q, edge))
    right = _around(pts, p, r, edge).join(left.select(*keys).distinct(), keys, "left_semi")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        who, far = k_least(a[q].to_numpy(np.float64), b[p].to_numpy(np.float64), b[p_id].to_numpy(), k, r * r)
        return pd.DataFrame({**{c: a[c] for c in q}, "_ids": pd.Series(who, dtype=object, index=a.index), "_far": pd.Series(far, dtype=object, index=a.index)})

    kind = pts.schema[p_id].dataType.simpleString()
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, ", ".join(f"{c} double" for c in q) + f", _ids array<{kind}>, _far array<double>")


def _by_joins(ask: DataFrame, pts: DataFrame, k: int, r: float, p_id: str) -> DataFrame:
    from arborlake.operators.spatial import radius_pairs

    n = len([c for c in ask.columns if c in _Q])
    q, p = _Q[:n], _P[:n]
    w = Window.partitionBy(*q).orderBy("d2", p_id)
    near = radius_pairs(ask, pts, r, q, p).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    near = near.groupBy(*q).agg(F.sort_array(F.collect_list(F.struct("_k", p_id, "d2"))).alias("l"))  # k of them
    near = near.select(*q, F.col(f"l.{p_id}").alias("_ids"), F.col("l.d2").alias("_far"))
    none = [F.coalesce(F.col(c), F.array().cast(near.schema[c].dataType)).alias(c) for c in ("_ids", "_far")]
    return ask.join(near, q, "left").select(*q, *none)


def _by_scan(ask: DataFrame, pts: DataFrame, k: int, r: float, p_id: str) -> DataFrame:
    """All at once, for at most ``_SCAN`` positions: each task keeps its k nearest points of
    each, and those are merged."""
    q = [c for c in ask.columns if c in _Q]
    p = _P[: len(q)]
    a = ask.select(*q).toPandas().to_numpy(np.float64)  # at most _SCAN

    def run(batches):
        ids, far = [np.zeros(0, np.int64)] * len(a), [np.zeros(0)] * len(a)
        for pdf in batches:
            more = k_least(a, pdf[p].to_numpy(np.float64), pdf[p_id].to_numpy(), k, r * r)
            for i, (m, d) in enumerate(zip(*more)):
                if len(m):
                    m, d = np.concatenate([ids[i], m]), np.concatenate([far[i], d])
                    by = np.lexsort((m, d))[:k]
                    ids[i], far[i] = m[by], d[by]
        size = [len(m) for m in ids]
        if sum(size):
            yield pd.DataFrame({"i": np.repeat(np.arange(len(a)), size), "d2": np.concatenate(far), "p": np.concatenate(ids)})

    kind = pts.schema[p_id].dataType.simpleString()
    near = pts.mapInPandas(run, f"i int, d2 double, p {kind}").groupBy("i").agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "p"))), 1, k).alias("l"))
    rows = ask.sparkSession.createDataFrame([(i, *map(float, x)) for i, x in enumerate(a)], ", ".join(["i int", *[f"{c} double" for c in q]]))
    got = rows.join(near, "i", "left").select(*q, F.col("l.p").alias("_ids"), F.col("l.d2").alias("_far"))
    return got.select(*q, *[F.coalesce(F.col(c), F.array().cast(got.schema[c].dataType)).alias(c) for c in ("_ids", "_far")])


def nearest(queries: DataFrame, pts: DataFrame, k: int, qxyz: list[str], pxyz: list[str], q_id: str, p_id: str, exclude_self: bool = True, max_r: float | None = None, rounds: int = 64) -> DataFrame:
    """(q_id, p_id, d2, rank) of the k nearest points of each query, no farther than ``max_r``;
    ties go to the smaller id.  Rows with a null or non-finite coordinate take no part.

    Each round looks within a radius for the positions that have not yet all their
    neighbours, then doubles it."""
    n = len(qxyz)
    q, p = _Q[:n], _P[:n]
    todo = finite(queries, qxyz).select(*[F.col(c).cast("double").alias(x) for c, x in zip(qxyz, q)]).distinct()
    todo = materialise(todo, "nn_ask")
    # One more than k, as a point may be its own neighbour.
    most = k + exclude_self
    same = Window.partitionBy(*p).orderBy(p_id)
    pts = finite(pts, pxyz).select(p_id, *[F.col(c).cast("double").alias(x) for c, x in zip(pxyz, p)]).where(F.col(p_id).isNotNull())
    pts = materialise(pts.withColumn("_k", F.row_number().over(same)).where(F.col("_k") <= most).drop("_k"), "nn_points")
    total = pts.count()
    kind = pts.schema[p_id].dataType
    if not total or todo.isEmpty() or k <= 0:
        return queries.select(q_id).where("false").withColumns({p_id: F.lit(None).cast(kind), "d2": F.lit(0.0), "rank": F.lit(1)})
    want = min(most, total)

    # A ball of a quarter of the edge holds about four times the neighbours wanted.
    every = pts.select(*p).unionAll(todo.select(*q))
    edge = block_edge(every, p, 15.3 * (4 * most + 16) * 2)
    r, out = edge / 4, None
    for k_round in range(rounds):
        last = max_r is not None and r >= max_r
        if last:
            r = max_r
        if todo.limit(_SCAN + 1).count() <= _SCAN:
            found, last = _by_scan(todo, pts, want, math.inf if max_r is None else max_r, p_id), True
        elif k_round < _BLOCK_ROUNDS:
            found = _by_blocks(todo, pts, want, r, max(edge, 4 * r), p_id)
        else:
            found = _by_joins(todo, pts, want, r, p_id)
        found = materialise(found, "nn_found")
        done = found if last else found.where(F.size("_ids") >= want)
        out = done if out is None else out.unionAll(done)
        if last:
            break
        old, todo = todo, materialise(found.where(F.size("_ids") < want).select(*q), "nn_ask")
        discard(old)
        if todo.isEmpty():
            break
        r *= 2
    else:
        raise RuntimeError(f"the nearest neighbours were not found in {rounds} doublings")
    at = [F.col(c).cast("double") == F.col(x) for c, x in zip(qxyz, q)]
    cond = at[0]
    for c in at[1:]:
        cond = cond & c
    got = F.arrays_zip(F.col("_ids").alias("p"), F.col("_far").alias("d2"))
    if exclude_self:
        got = F.filter(got, lambda x: x["p"] != F.col("_id"))
    near = finite(queries, qxyz).select(F.col(q_id).alias("_id"), *qxyz).join(out, cond).select("_id", F.posexplode(F.slice(got, 1, k)).alias("rank", "_n"))
    return near.select(F.col("_id").alias(q_id), F.col("_n.p").alias(p_id), F.col("_n.d2").alias("d2"), (F.col("rank") + 1).alias("rank"))
