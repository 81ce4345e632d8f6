"""The two processing pipelines as named stages; each stage's table is committed before the
next one starts, so a stopped run resumes behind the last stage that was finished."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators import segment, spatial, terrain, tiling
from arborlake.operators.graph import drop_small_components


@dataclass
class PlotConfig:
    """Lengths in metres.  ``order`` tells which of equal points is the first."""

    tile_size: float = 10.0
    intensity_threshold: float = 0.0
    remove_duplicates: bool = False
    ground_offset: float = 0.2
    ground_cell: float = 0.5
    terrain_cell: float = 0.1
    cloth_resolution: float = 2.0
    cloth_threshold: float = 0.5
    denoise_voxel: float = 0.1
    denoise_points: int = 0
    patch: float = 0.1
    ball: float = 0.12
    nmin: int = 3
    max_dist: float = 0.3
    base_height: float = 1.0
    layer_size: float = 0.15
    min_segment: int = 100
    cylinder_layer: float = 0.5
    order: list[str] = field(default_factory=lambda: ["point_id"])


Stage = Callable[[DataFrame, PlotConfig], DataFrame]


def _ground(p: DataFrame, c: PlotConfig) -> DataFrame:
    return terrain.cloth_ground(p, c.cloth_resolution, c.cloth_threshold)


def _normalise(p: DataFrame, c: PlotConfig) -> DataFrame:
    """Heights above terrain; ground itself and what lies under it go; x and y centred."""
    g = p.where("is_ground")
    up = terrain.above_ground(p, g, c.ground_offset, c.ground_cell)
    return tiling.centre(terrain.subtract(up, terrain.terrain(g, c.terrain_cell), c.terrain_cell).drop("z_raw"))


def _segment(p: DataFrame, c: PlotConfig) -> DataFrame:
    p = p.where(F.col("intensity") > c.intensity_threshold) if c.intensity_threshold > 0 else p
    return segment.segment_trees(segment.cover_sets(p, "point_id", c.patch, c.ball, c.nmin), c.max_dist, c.base_height, c.layer_size)


FULL: list[tuple[str, Stage]] = [
    ("dedup", lambda p, c: tiling.dedup(p, c.order) if c.remove_duplicates else p),
    ("ground", _ground),
    ("normalise", _normalise),
    ("tiles", lambda p, c: spatial.assign_tiles(p, c.tile_size)),
    ("denoise", lambda p, c: drop_small_components(p, c.denoise_voxel, c.denoise_points) if c.denoise_points else p),
    ("segment", _segment),
]
LITE: list[tuple[str, Stage]] = [
    ("centre", lambda p, c: tiling.centre(p, True)),
    ("ground", lambda p, c: terrain.above_mean_ground(_ground(p, c), F.col("is_ground"))),
    ("intensity", lambda p, c: p.where(F.col("intensity") > c.intensity_threshold) if c.intensity_threshold > 0 else p),
    ("denoise", lambda p, c: drop_small_components(p, c.denoise_voxel, c.denoise_points) if c.denoise_points else p),
    ("segment", lambda p, c: segment.segment_trees(segment.cover_sets(p.withColumn("z", F.col("z_raw")), "point_id", c.patch, c.ball, c.nmin), c.max_dist, c.base_height, c.layer_size, min_height=-1e9)),
]


def run_pipeline(spark: SparkSession, points: DataFrame, out_dir: str, config: PlotConfig | None = None, mode: str = "full") -> tuple[DataFrame, DataFrame]:
    """points (point_id, x, y, z, intensity) -> labelled points and cylinders, both written
    under out_dir.  Stages that are already there are read instead of run; their names hold a
    digest of the configuration, the mode and the input's files and columns, so that nothing of
    another run is taken."""
    c = config or PlotConfig()
    p = points
    of = repr((c, mode, sorted(points.inputFiles()), points.dtypes))
    digest = hashlib.md5(of.encode()).hexdigest()[:8]
    for i, (name, stage) in enumerate(FULL if mode == "full" else LITE):
        path = os.path.join(out_dir, f"{i:02d}_{name}_{digest}")
        try:
            p = spark.read.parquet(path)
        except AnalysisException:
            stage(p, c).write.mode("overwrite").parquet(path)
            p = spark.read.parquet(path)
    if p.isEmpty():
        raise tiling.EmptyCloudError("no point is left; lower the intensity threshold or the ground offset")
    path = os.path.join(out_dir, f"cylinders_{digest}")
    try:
        return p, spark.read.parquet(path)
    except AnalysisException:
        pass
    segment.fit_cylinders(p, min_points=c.min_segment, layer=c.cylinder_layer).write.mode("overwrite").parquet(path)
    return p, spark.read.parquet(path)
