"""Circle and shape fits that are sums: any group size, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def circle_fit(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Algebraic least-squares circle of each group: cx, cy, r, n.  Coordinates are centred
    first, then the normal equations are solved in closed form from sums of powers; points on
    a line have no circle (nulls)."""
    m = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.count("*").alias("n"))
    d = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).join(m, keys)
    u, v = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
    s = d.groupBy(*keys).agg(
        F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.first("n").alias("n"),
        F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"),
        F.sum(u * u * u + u * v * v).alias("p"), F.sum(v * v * v + v * u * u).alias("q"),
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    det = F.when(F.abs(det) > 1e-12, det)
    a = (F.col("p") * F.col("vv") - F.col("q") * F.col("uv")) / det / 2
    b = (F.col("q") * F.col("uu") - F.col("p") * F.col("uv")) / det / 2
    r = F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n"))
    return s.select(*keys, (a + F.col("_mx")).alias("cx"), (b + F.col("_my")).alias("cy"), r.alias("r"), "n")


def circle_rmse(df: DataFrame, fit: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Root mean square distance to the fitted circle, and relative to its radius."""
    from arborlake.functions.geometry import circle_residual

    e = circle_residual(x, y, "cx", "cy", "r")
    g = df.join(fit, keys).groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.first("r").alias("r"))
    return g.select(*keys, "rmse", F.try_divide("rmse", "r").alias("relative_rmse"))


def covariance(df: DataFrame, keys: list[str], xyz: list[str] = ["x", "y", "z"]) -> DataFrame:  # noqa: B006
    """Population covariances of each group."""
    x, y, z = xyz
    pairs = [("xx", x, x), ("yy", y, y), ("zz", z, z), ("xy", x, y), ("xz", x, z), ("yz", y, z)]
    return df.groupBy(*keys).agg(*[F.covar_pop(a, b).alias(n) for n, a, b in pairs], F.count("*").alias("n"))


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, smallest first, in trigonometric form."""
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + (xy * xy + xz * xz + yz * yz) * 2
    p = F.greatest(F.sqrt(p2 / 6), F.lit(1e-300))
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3
    top = q + p * 2 * F.cos(phi)
    low = q + p * 2 * F.cos(phi + F.lit(2.0943951023931953))
    return [low, q * 3 - top - low, top]


def curvature(cov: DataFrame) -> DataFrame:
    """Surface variation and linearity from covariances."""
    l0, l1, l2 = eigenvalues(*[F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")])
    return cov.withColumn("curvature", F.try_divide(F.greatest(l0, F.lit(0.0)), l0 + l1 + l2)).withColumn("linearity", F.try_divide(l2 - l1, l2))


def principal_axes(cov: DataFrame, keys: list[str]) -> DataFrame:
    """Unit vector of the largest spread of each group, z up, from its covariances; one small
    matrix a row."""
    import numpy as np
    import pandas as pd

    names = ["xx", "yy", "zz", "xy", "xz", "yz"]
    fields = ", ".join(f"{k} {cov.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            xx, yy, zz, xy, xz, yz = (pdf[c].to_numpy(np.float64) for c in names)
            m = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1)
            v = np.linalg.eigh(m)[1][:, :, 2] if len(m) else np.zeros((0, 3))
            v = np.where(v[:, 2:] < 0, -v, v)
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(v, columns=["ax", "ay", "az"])], axis=1)

    return cov.select(*keys, *names).mapInPandas(run, f"{fields}, ax double, ay double, az double")
