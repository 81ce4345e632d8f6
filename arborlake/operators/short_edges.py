"""The edges within a radius that shortest paths and spanning forests can use.

With squared distances as weights, an edge a-b is of no use if some point c lies well inside the
ball that has it as a diameter: |ac|^2 + |cb|^2 < |ab|^2, so the way over c is shorter, and both
its edges are shorter than a-b.  What is left is the Gabriel graph, a few edges a point, where
all pairs within the radius grow with the square of the points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.nearest import _around, _cells, block_edge, finite
from arborlake.plans.stage import materialise

#: Weights may be rounded to nine digits; a way over c must be shorter by more than that can hide.
MARGIN = 2e-9
_XYZ = ["_x", "_y", "_z"]
_NEAR = "_id {kind}, _x double, _y double, _z double, done boolean, ids array<{kind}>, far array<double>, at array<double>"


def directions(n: int = 300) -> tuple[np.ndarray, float]:
    """Unit vectors along a spiral, and an angle within which every direction has one of them."""
    k = np.arange(n) + 0.5
    z, turn = 1 - 2 * k / n, np.pi * (1 + 5**0.5) * k
    side = np.sqrt(1 - z * z)
    # The spiral's widest gap is near 2.7 / sqrt(n); tests measure it.
    return np.stack([side * np.cos(turn), side * np.sin(turn), z], axis=1), 3.0 / n**0.5


_NET, _ANGLE = directions()


def useful(b: np.ndarray, d2: np.ndarray, first: int = 16) -> np.ndarray:
    """Which points b (seen from a, nearest first) no other one makes useless."""
    keep = np.arange(len(b))
    for c, c2 in ((b[:first], d2[:first]), (None, None)):
        if c is None:
            c, c2 = b[keep], d2[keep]
        keep = keep[~(b[keep] @ c.T >= c2 + MARGIN).any(axis=1)] if len(keep) else keep
    return keep


def closed(b: np.ndarray, d2: np.ndarray, r: float, most: int = 64) -> bool:
    """Whether the points b seen from a make all points beyond r useless, in any direction."""
    b, d = b[:most][d2[:most] > 0], np.sqrt(d2[:most][d2[:most] > 0])
    if not len(b):
        return False
    cos = np.clip(_NET @ (b / d[:, None]).T, -1, 1)
    least = cos * np.cos(_ANGLE) - np.sqrt(1 - cos * cos) * np.sin(_ANGLE)
    # Angles that the net's gap would carry beyond a half turn have no such cosine.
    least = np.where(cos > -np.cos(_ANGLE), least, -1.0)
    return bool((least * r >= d + MARGIN / d).any(axis=1).all())


def _seen_from(a: np.ndarray, b: np.ndarray, r2: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in b of the points within the radius other than a, nearest first, and their d2."""
    d2 = (a[0] - b[:, 0]) ** 2
    d2 += (a[1] - b[:, 1]) ** 2
    d2 += (a[2] - b[:, 2]) ** 2
    at = np.flatnonzero((d2 <= r2) & (b != a).any(axis=1))
    at = at[np.argsort(d2[at], kind="stable")]
    return at, d2[at]


def _by_blocks(ask: DataFrame, pts: DataFrame, r: float, edge: float, last: bool, kind: str) -> DataFrame:
    keys, p = [f"_b{i}" for i in range(3)], ["_px", "_py", "_pz"]
    left = ask.select("_id", *_XYZ, *_cells(_XYZ, edge))
    right = _around(pts.select(F.col("_id").alias("_pid"), *[F.col(c).alias(x) for c, x in zip(_XYZ, p)]), p, r, edge)
    right = right.join(left.select(*keys).distinct(), keys, "left_semi")

    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, xyz, rows = b["_pid"].to_numpy(), b[p].to_numpy(np.float64), []
        for i, a in zip(q["_id"], q[_XYZ].to_numpy(np.float64)):
            at, d2 = _seen_from(a, xyz, r * r)
            way = xyz[at] - a
            keep = useful(way, d2)
            rows.append((i, *a, last or closed(way, d2, r), ids[at[keep]], d2[keep], xyz[at[keep]].ravel()))
        return pd.DataFrame(rows, columns=["_id", *_XYZ, "done", "ids", "far", "at"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, _NEAR.format(kind=kind))


def _by_scan(ask: pd.DataFrame, pts: DataFrame, r: float, kind: str) -> DataFrame:
    """All points past the asking ones at once, which know useful neighbours already: (i, id, d2)
    and the point, of those that they leave."""
    mine = ask[_XYZ].to_numpy(np.float64)
    known = [np.asarray(v, dtype=np.float64).reshape(-1, 3) for v in ask["at"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, xyz, who, out = pdf["_id"].to_numpy(), pdf[_XYZ].to_numpy(np.float64), [], []
            for i, (a, c) in enumerate(zip(mine, known)):
                at, d2 = _seen_from(a, xyz, r * r)
                c = c - a
                at, d2 = (x[~((xyz[at] - a) @ c.T >= (c * c).sum(axis=1) + MARGIN).any(axis=1)] for x in (at, d2)) if len(c) else (at, d2)
                keep = useful(xyz[at] - a, d2)
                who.append(np.full(len(keep), i)), out.append((at[keep], d2[keep]))
            at = np.concatenate([x for x, _ in out])
            yield pd.DataFrame({"i": np.concatenate(who), "id": ids[at], "d2": np.concatenate([x for _, x in out]), **{c: xyz[at, k] for k, c in enumerate(_XYZ)}})

    def prune(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("d2", kind="stable")
        return g.iloc[useful(g[_XYZ].to_numpy(np.float64) - mine[int(g["i"].iloc[0])], g["d2"].to_numpy())][["i", "id", "d2"]]

    # Few bytes and much work: dealt to all cores.
    pts = pts.repartition(pts.sparkSession.sparkContext.defaultParallelism, "_id")
    return pts.mapInPandas(run, f"i int, id {kind}, d2 double, _x double, _y double, _z double").groupBy("i").applyInPandas(prune, f"i int, id {kind}, d2 double")


def short_edges(pts: DataFrame, r: float, id_col: str, xyz: list[str], scan: int = 20_000, rounds: int = 2) -> DataFrame:
    """(src < dst, d2) of points in space within r: enough of their pairs for the same shortest
    paths by d2, or d2 rounded to nine digits, and the same minimum spanning forest (equal weights
    ordered by the nodes).  Rows with a null id or a coordinate that is no finite number take no part.

    Copies of a position are linked to the least id there, which stands for them.  Each round
    looks within a radius, until what is near shuts off all that is farther or the radius is r;
    at most ``scan`` points that are left after ``rounds`` doublings, those at the rim, are
    compared with all points at once."""
    kind = pts.schema[id_col].dataType.simpleString()
    every = finite(pts, xyz).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(x) for c, x in zip(xyz, _XYZ)])
    every = materialise(every.distinct(), "se_points")
    reps = materialise(every.groupBy(*_XYZ).agg(F.min("_id").alias("_id")).select("_id", *_XYZ), "se_places")
    copies = every.join(reps.withColumnRenamed("_id", "_least"), _XYZ).where("_id > _least").select(F.col("_least").alias("src"), F.col("_id").alias("dst"), F.lit(0.0).alias("d2"))

    # A ball of a quarter of the edge holds about a hundred points.
    edge = block_edge(reps, _XYZ, 15.3 * 100)
    near, todo, out, k = edge / 4, reps, copies, 0
    while True:
        last = near >= r
        found = materialise(_by_blocks(todo, reps, min(near, r), max(edge, 4 * min(near, r)), last, kind), "se_found")
        pairs = found.where("done").select("_id", F.explode(F.arrays_zip("ids", "far")).alias("n")).select("_id", F.col("n.ids").alias("id"), F.col("n.far").alias("d2"))
        out = out.unionAll(pairs.select(F.least("_id", "id").alias("src"), F.greatest("_id", "id").alias("dst"), "d2"))
        todo, k = found.where("not done"), k + 1
        if last or todo.isEmpty():
            break
        if k >= rounds and todo.limit(scan + 1).count() <= scan:
            ask = todo.select("_id", *_XYZ, "at").toPandas()  # at most ``scan``
            rows = pts.sparkSession.createDataFrame(pd.DataFrame({"i": np.arange(len(ask)), "_id": ask["_id"]}), f"i int, _id {kind}")
            pairs = _by_scan(ask, reps, r, kind).join(rows, "i")
            out = out.unionAll(pairs.select(F.least("_id", "id").alias("src"), F.greatest("_id", "id").alias("dst"), "d2"))
            break
        near *= 2
    return out.where("src < dst").groupBy("src", "dst").agg(F.min("d2").alias("d2"))
