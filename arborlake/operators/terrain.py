"""Ground, terrain rasters and heights above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_cell(size: float, x: str = "x", y: str = "y", x0: float = 0.0, y0: float = 0.0) -> list[Column]:
    return [F.floor((F.col(x) - x0) / size).cast("int").alias("ix"), F.floor((F.col(y) - y0) / size).cast("int").alias("iy")]


def raster_max(pts: DataFrame, size: float) -> DataFrame:
    return pts.groupBy(*grid_cell(size)).agg(F.max("z").alias("z"))


def ground_level(ground: DataFrame, size: float = 0.5, p: float = 0.95) -> DataFrame:
    """Percentile of the ground's heights in each cell."""
    return ground.groupBy(*grid_cell(size)).agg(F.percentile("z", F.lit(p)).alias("z"))


def fill_nearest(known: DataFrame, wanted: DataFrame, start: int = 1, rounds: int = 16) -> DataFrame:
    """z of each wanted cell (ix, iy): its own, or that of the nearest known cell, ties to the
    smaller (ix, iy).  Missing cells look in squares of cells, doubled until one is found and
    no nearer one can lie outside."""
    from arborlake.plans.stage import materialise

    have = wanted.select("ix", "iy").distinct().join(known, ["ix", "iy"], "left")
    out = have.where("z is not null").select("ix", "iy", "z")
    todo = materialise(have.where("z is null").select("ix", "iy"), "fill_todo")
    r = start
    for _ in range(rounds):
        if todo.isEmpty() or known.isEmpty():
            break
        # Cells of edge r: a neighbour within r lies in one of nine.
        t = todo.withColumn("bx", F.explode(F.sequence(F.floor(F.col("ix") / r) - 1, F.floor(F.col("ix") / r) + 1)))
        t = t.withColumn("by", F.explode(F.sequence(F.floor(F.col("iy") / r) - 1, F.floor(F.col("iy") / r) + 1)))
        k = known.select(F.col("ix").alias("kx"), F.col("iy").alias("ky"), "z", F.floor(F.col("ix") / r).alias("bx"), F.floor(F.col("iy") / r).alias("by"))
        d2 = (F.col("ix") - F.col("kx")) * (F.col("ix") - F.col("kx")) + (F.col("iy") - F.col("ky")) * (F.col("iy") - F.col("ky"))
        got = t.join(k, ["bx", "by"]).withColumn("d2", d2).where(F.col("d2") <= r * r)
        got = materialise(got.groupBy("ix", "iy").agg(F.min_by("z", F.struct("d2", "kx", "ky")).alias("z")), "fill_found")
        out = out.unionAll(got.select("ix", "iy", "z"))
        todo = materialise(todo.join(got, ["ix", "iy"], "left_anti"), "fill_todo")
        r *= 2
    return out


def terrain(ground: DataFrame, cell: float) -> DataFrame:
    """Highest ground in each cell."""
    return raster_max(ground, cell)


def subtract(pts: DataFrame, ter: DataFrame, cell: float) -> DataFrame:
    """Heights above the terrain; z_raw keeps the old ones.  Cells without terrain take the
    nearest one."""
    cells = pts.select(*grid_cell(cell)).distinct()
    filled = fill_nearest(ter, cells)
    ix, iy = grid_cell(cell)
    p = pts.withColumn("ix", ix).withColumn("iy", iy)
    j = p.join(filled.withColumnRenamed("z", "_t"), ["ix", "iy"], "left")
    return j.withColumn("z_raw", F.col("z")).withColumn("z", F.col("z") - F.coalesce("_t", F.lit(0.0))).drop("_t", "ix", "iy")


def restore(pts: DataFrame) -> DataFrame:
    """Heights as they were before the terrain was taken off."""
    return pts.withColumn("z", F.col("z_raw"))


def above_ground(pts: DataFrame, ground: DataFrame, offset: float = 0.2, size: float = 0.5) -> DataFrame:
    """Points strictly more than offset above their cell's (or the nearest cell's) ground."""
    level = fill_nearest(ground_level(ground, size), pts.select(*grid_cell(size)).distinct())
    ix, iy = grid_cell(size)
    p = pts.withColumn("ix", ix).withColumn("iy", iy).join(level.withColumnRenamed("z", "_g"), ["ix", "iy"])
    return p.where(F.col("z") > F.col("_g") + offset).drop("_g", "ix", "iy")


def above_mean_ground(pts: DataFrame, is_ground: Column, under_ground: bool = True) -> DataFrame:
    """Points that are no ground and, unless ``under_ground`` is off, lie above its mean."""
    g = F.broadcast(pts.agg(F.avg(F.when(is_ground, F.col("z"))).alias("_g")))  # one row
    keep = ~is_ground
    out = pts.crossJoin(g)
    return out.where(keep & (F.col("z") > F.col("_g")) if under_ground else keep).drop("_g")


def densest_band(pts: DataFrame, band: float, threshold: float, area: float | None = None) -> DataFrame:
    """One row: the first height band that holds more than area * threshold points, else the
    fullest (the lower of equals), with its upper edge."""
    box = F.broadcast(pts.agg(F.min("z").alias("z0"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("a")))
    b = pts.crossJoin(box).groupBy(F.floor((F.col("z") - F.col("z0")) / band).alias("band")).agg(F.count("*").alias("n"), F.first("z0").alias("z0"), F.first("a").alias("a"))
    full = F.col("n") > (F.lit(area) if area is not None else F.col("a")) * threshold
    m = b.agg(F.min(F.when(full, F.col("band"))).alias("first"), F.max_by("band", F.struct("n", -F.col("band"))).alias("fullest"), F.first("z0").alias("z0"))
    m = m.select(F.coalesce("first", "fullest").alias("band"), "z0")
    return m.select("band", (F.col("z0") + (F.col("band") + 1) * band).alias("band_top"))


def above_band(pts: DataFrame, band: float, threshold: float, offset: float = 0.2) -> DataFrame:
    top = F.broadcast(densest_band(pts, band, threshold).select("band_top"))
    return pts.crossJoin(top).where(F.col("z") > F.col("band_top") + offset).drop("band_top")


def cloth_ground(pts: DataFrame, resolution: float = 2.0, threshold: float = 0.5, rounds: int = 5) -> DataFrame:
    """Column is_ground: within ``threshold`` of a surface through the lowest point of each
    cell, drawn smooth by ``rounds`` means with the eight neighbours that never rise above
    the lowest point."""
    from arborlake.plans.stage import materialise

    low = pts.groupBy(*grid_cell(resolution)).agg(F.min("z").alias("low"))
    cloth = low.withColumn("c", F.col("low"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    for k in range(rounds):
        spread = cloth.select("ix", "iy", "c", step.alias("s")).select((F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy"), "c")
        mean = spread.groupBy("ix", "iy").agg(F.avg("c").alias("m"))
        cloth = cloth.join(mean, ["ix", "iy"]).select("ix", "iy", "low", F.least("low", "m").alias("c"))
        if k % 2:
            cloth = materialise(cloth, "cloth")
    ix, iy = grid_cell(resolution)
    p = pts.withColumn("ix", ix).withColumn("iy", iy).join(cloth.select("ix", "iy", "c"), ["ix", "iy"])
    return p.withColumn("is_ground", F.abs(F.col("z") - F.col("c")) < threshold).drop("ix", "iy", "c")
