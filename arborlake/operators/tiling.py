"""Hygiene of point tables: centring, duplicates, tiles, labels, sampling, exact matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.operators.ordered import running_totals


class EmptyCloudError(RuntimeError):
    """No tile holds a point."""


def centre(pts: DataFrame, with_z: bool = False) -> DataFrame:
    """x and y (and z) minus their means over all points; the means stay as mean_x ...; the
    raw height stays as z_raw."""
    axes = ["x", "y", "z"] if with_z else ["x", "y"]
    mean = F.broadcast(pts.agg(*[F.avg(a).alias(f"mean_{a}") for a in axes]))  # one row
    out = pts.withColumn("z_raw", F.col("z")).crossJoin(mean)
    return out.withColumns({a: F.col(a) - F.col(f"mean_{a}") for a in axes})


def restore(pts: DataFrame, with_z: bool = False) -> DataFrame:
    axes = ["x", "y", "z"] if with_z else ["x", "y"]
    return pts.withColumns({a: F.col(a) + F.col(f"mean_{a}") for a in axes}).drop(*[f"mean_{a}" for a in axes])


def dedup(pts: DataFrame, order: list[str]) -> DataFrame:
    """One point for each (x, y, z): the first in ``order``.  A map-side aggregate, so copies
    of one place never meet in one task."""
    rest = [c for c in pts.columns if c not in ("x", "y", "z")]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return pts.groupBy("x", "y", "z").agg(first).select("x", "y", "z", *[F.col(f"_r.{c}").alias(c) for c in rest]).select(pts.columns)


def recombine(tiles: list[DataFrame], check: bool = True) -> DataFrame:
    """All points of all tiles; empty tiles add nothing."""
    if not tiles:
        raise EmptyCloudError("there is no tile to recombine; assign tiles first")
    out = tiles[0]
    for t in tiles[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    if check and out.isEmpty():
        raise EmptyCloudError("all tiles are empty; lower the intensity threshold or the least segment size, or check the ground filter")
    return out


def min_segment(pts: DataFrame, n: int, label: str = "segment_label") -> DataFrame:
    """Points of labels of at least 0 with n points or more."""
    big = pts.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(label)
    return pts.join(big, label, "left_semi")


def percentile_filter(pts: DataFrame, column: str, p: float) -> DataFrame:
    """Rows not below the p-th percentile, interpolated."""
    cut = F.broadcast(pts.agg(F.percentile(column, F.lit(p / 100)).alias("_cut")))  # one row
    return pts.crossJoin(cut).where(F.col(column) >= F.col("_cut")).drop("_cut")


def label_offsets(pts: DataFrame, tile: str, label: str = "segment_label") -> DataFrame:
    """Labels made unique over tiles: each tile's go on after the largest of those before it;
    negative ones stay."""
    per = pts.groupBy(tile).agg(F.max(F.when(F.col(label) >= 0, F.col(label) + 1).otherwise(0)).alias("_k"))
    offs = running_totals(per, [F.col(tile)], {"_o": F.col("_k")}).select(tile, "_o")
    return pts.join(offs, tile).withColumn(label, F.when(F.col(label) >= 0, F.col(label) + F.col("_o")).otherwise(F.col(label)).cast("long")).drop("_o")


def global_ids(df: DataFrame, tile: str, local: str, name: str = "global_id") -> DataFrame:
    """Running numbers from 0 of the distinct (tile, local id), in order: each tile's own
    numbers after the sum of the tiles before, so no sort holds all ids."""
    ids = df.select(tile, local).distinct()
    per = ids.groupBy(tile).agg(F.count("*").alias("_k"))
    offs = running_totals(per, [F.col(tile)], {"_o": F.col("_k")}).select(tile, "_o")
    return ids.join(offs, tile).withColumn(name, F.col("_o") + F.row_number().over(Window.partitionBy(tile).orderBy(local)) - 1).drop("_o")


def mm_key(x: Column) -> Column:
    return F.bround(x * 1000).cast("long")


def mm_join(pts: DataFrame, fields: DataFrame, value: list[str], order: list[str]) -> DataFrame:
    """Fields of another scan at the same place to a millimetre of x and y; where it has
    several rows the first in ``order`` holds.  Points without one keep nulls."""
    f = fields.groupBy(mm_key(F.col("x")).alias("_kx"), mm_key(F.col("y")).alias("_ky")).agg(F.min_by(F.struct(*value), F.struct(*order)).alias("_f"))
    j = pts.join(f, (mm_key(pts["x"]) == f["_kx"]) & (mm_key(pts["y"]) == f["_ky"]), "left")
    return j.select(*[pts[c] for c in pts.columns], *[F.col(f"_f.{v}").alias(f"field_{v}") for v in value])


def stride_sample(df: DataFrame, row_no: str, most: int) -> DataFrame:
    """Every step-th row so that at most ``most`` are left; row_no counts rows from 0."""
    n = F.broadcast(df.agg(F.greatest(F.ceil(F.count("*") / F.lit(most)), F.lit(1)).alias("_step")))  # one row
    return df.crossJoin(n).where(F.pmod(F.col(row_no), F.col("_step")) == 0).drop("_step")


def hash_sample(df: DataFrame, key: list[Column], n: int, seed: str = "sample") -> DataFrame:
    """n rows without replacement, the same ones in every run: those with the least digests of
    their key, which should tell all rows apart."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in key])
    return df.orderBy(F.md5(text.cast("binary")), *key).limit(n)


def enough_points(pts: DataFrame, keys: list[str], least: int = 25) -> DataFrame:
    """Points of groups (tiles) that hold at least ``least`` of them."""
    full = pts.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return pts.join(full, keys, "left_semi")


def positional_join(a: DataFrame, b: DataFrame, a_order: list[Column], b_order: list[Column]) -> DataFrame:
    """Row by row, each side in its order; columns of both must differ.  Sides of different
    length have no rows in common: an error."""
    x, y = running_totals(a, a_order, row_no="_ra"), running_totals(b, b_order, row_no="_rb")
    if x.count() != y.count():
        raise ValueError("the tables differ in length, so rows do not belong together")
    return x.join(y, x["_ra"] == y["_rb"]).drop("_ra", "_rb")


def first_per_voxel(pts: DataFrame, size: float, order: list[str]) -> DataFrame:
    rest = F.struct(*pts.columns)
    key = [F.floor(F.col(a) / size).alias(f"_v{a}") for a in "xyz"]
    return pts.groupBy(*key).agg(F.min_by(rest, F.struct(*order)).alias("_r")).select("_r.*")


def layer_index(z: Column, min_height: float = 0.0, base_height: float = 0.3, layer_size: float = 0.3) -> Column:
    """0 strictly between min_height and base_height, then layers of layer_size; a height on
    an edge, or below all layers, has none."""
    k = (z - base_height) / layer_size
    up = F.floor(k)
    return F.when((z > min_height) & (z < base_height), F.lit(0)).when((z > base_height) & (k != up), up.cast("int") + 1)


def grid_denoise(pts: DataFrame, cell: float = 0.1, min_points: int = 3) -> DataFrame:
    """Points of cells that hold at least min_points points."""
    key = [F.floor(F.col(a) / cell).alias(f"_v{a}") for a in "xyz"]
    full = pts.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_points)
    on = [F.floor(pts[a] / cell) == full[f"_v{a}"] for a in "xyz"]
    return pts.join(full, on[0] & on[1] & on[2], "left_semi")


def matched_fields(joined: DataFrame, prefix: str = "field_") -> list[str]:
    """Joined fields that some point has with a value other than 0."""
    names = [c for c in joined.columns if c.startswith(prefix)]
    hit = joined.agg(*[F.max((F.coalesce(F.col(c), F.lit(0)) != 0).cast("int")).alias(c) for c in names]).first()
    return [c for c in names if hit[c]]


def drop_unmatched_fields(joined: DataFrame, prefix: str = "field_") -> DataFrame:
    keep = set(matched_fields(joined, prefix))
    return joined.select(*[c for c in joined.columns if not c.startswith(prefix) or c in keep])
