"""Runs: a folder with metadata.json and the tables of one processed plot."""

from __future__ import annotations

import datetime as dt
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = (
    "run_name string, timestamp string, input_folder string, run_dir string, cylinder_file string, cylinder_count long, point_count long, qsm_enabled boolean, "
    "has_point_cloud boolean, has_segment_labels boolean, config_snapshot map<string,string>, cloud_mean array<double>"
)
TREE_METRICS = ["tree_id", "tile", "n_cylinders", "height_m", "dbh_cm", "basal_diam_cm", "total_volume_l", "trunk_volume_l", "branch_volume_l", "max_branch_order", "n_branch_orders"]
CYLINDER = ["sx", "sy", "sz", "radius", "ax", "ay", "az", "length"]


def new_run_dir(root: str, name: str, now: dt.datetime | None = None) -> str:
    """root/name, with the time behind it if that is taken."""
    path = os.path.join(root, re.sub(r"\W", "_", name).strip("_") or "run")
    if os.path.exists(path):
        path += f"_{(now or dt.datetime.now()):%Y%m%d_%H%M%S}"
    return path


def find_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs below root, newest first: path, modified and the metadata; broken files have null
    metadata."""
    f = spark.read.format("binaryFile").load(os.path.join(root, "*", "metadata.json"))
    j = f.select(F.col("path"), F.col("modificationTime").alias("modified"), F.from_json(F.col("content").cast("string"), METADATA, {"mode": "PERMISSIVE"}).alias("m"))
    return newest_first(j.select("path", "modified", "m.*"), "modified", "path")


def newest_first(runs: DataFrame, time: str, name: str) -> DataFrame:
    """Latest first; of equal times the smaller name."""
    return runs.orderBy(F.col(time).desc_nulls_last(), name)


def read_cylinders(spark: SparkSession, path: str) -> DataFrame:
    """Cylinders from text: eight numbers a line, a ninth is the branch order; other lines
    are left out."""
    v = F.split(F.trim(F.col("value")), r"[\s,]+")
    t = spark.read.text(path).select(v.alias("v")).where(F.size("v") >= 8)
    num = lambda i: F.get("v", F.lit(i)).try_cast("double")
    out = t.select(*[num(i).alias(c) for i, c in enumerate(CYLINDER)], num(8).cast("int").alias("branch_order"))
    return out.where(F.col("sx").isNotNull() & F.col("length").isNotNull())


def write_cylinders(cyl: DataFrame, path: str, shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
    """Nine columns a line, moved back to the world's frame."""
    at = [(F.col(c) + m).cast("string") for c, m in zip(("sx", "sy", "sz"), shift)]
    rest = [F.col(c).cast("string") for c in CYLINDER[3:]]
    cyl.select(F.concat_ws(" ", *at, *rest, F.coalesce(F.col("branch_order"), F.lit(0)).cast("string")).alias("value")).write.mode("overwrite").text(path)


@dataclass
class Run:
    """The tables of a run; only the points must be there."""

    path: str
    points: DataFrame
    cylinders: DataFrame | None
    mean: tuple[float, float, float]
    epsg: int | None

    @staticmethod
    def open(spark: SparkSession, path: str, epsg: int | None = None) -> Run:
        from pyspark.errors import AnalysisException

        try:
            pts = spark.read.parquet(os.path.join(path, "points"))
        except AnalysisException as e:
            raise FileNotFoundError(f"{path} holds no point table") from e
        for c, kind in (("segment_label", "int"), ("cover_set", "int")):
            if c not in pts.columns:
                pts = pts.withColumn(c, F.lit(None).cast(kind))
        try:
            cyl: DataFrame | None = spark.read.parquet(os.path.join(path, "cylinders"))
        except AnalysisException:
            cyl = None
        meta = spark.read.text(os.path.join(path, "metadata.json"), wholetext=True).select(F.from_json("value", METADATA).alias("m")).select("m.*").first()
        mean = tuple(meta["cloud_mean"]) if meta and meta["cloud_mean"] else (0.0, 0.0, 0.0)
        return Run(path, pts, cyl, mean, epsg)

    @property
    def has_mean(self) -> bool:
        return any(self.mean)

    def save(self, spark: SparkSession, name: str, config: dict[str, object] | None = None) -> None:
        self.points.select(*[F.col(c).cast("float").alias(c) if c in ("x", "y", "z", "intensity") else F.col(c) for c in self.points.columns]).write.mode("overwrite").parquet(os.path.join(self.path, "points"))
        if self.cylinders is not None:
            self.cylinders.write.mode("overwrite").parquet(os.path.join(self.path, "cylinders"))
        n_cyl = self.cylinders.count() if self.cylinders is not None else 0
        import json

        meta = {
            "run_name": name, "timestamp": dt.datetime.now().isoformat(timespec="seconds"), "run_dir": self.path, "cylinder_count": n_cyl, "point_count": spark.read.parquet(os.path.join(self.path, "points")).count(),
            "qsm_enabled": self.cylinders is not None, "has_point_cloud": True, "has_segment_labels": "segment_label" in self.points.columns, "config_snapshot": {k: str(v) for k, v in (config or {}).items()}, "cloud_mean": list(self.mean),
        }
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        target = fs.Path(os.path.join(self.path, "metadata.json"))
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(json.dumps(meta, indent=1).encode()))
        out.close()

    def query(self, obs: DataFrame, sizes: tuple[float, ...] = (1.0, 2.0, 3.0), default_h: float = 2.0) -> DataFrame:
        """Batch voxel query at world places (obs_id, wx, wy, h above ground)."""
        from arborlake.operators import voxel

        spark = self.points.sparkSession
        cyl = self.cylinders
        if cyl is None:
            cyl = spark.createDataFrame([], "sx double, sy double, sz double, radius double, length double, branch_order int")
        return voxel.batch_query(obs, self.points, cyl, sizes, default_h, self.mean[:2])

    def query_lonlat(self, obs: DataFrame, sizes: tuple[float, ...] = (1.0, 2.0, 3.0), default_h: float = 2.0) -> DataFrame:
        """The same at (obs_id, lon, lat, h)."""
        from arborlake.functions.geometry import utm

        if self.epsg is None:
            raise ValueError("the run has no coordinate reference system; give Run.open an epsg code")
        e, n = utm("lon", "lat", self.epsg)
        return self.query(obs.select("obs_id", e.alias("wx"), n.alias("wy"), "h"), sizes, default_h)


def read_observations(spark: SparkSession, path: str, default_h: float = 2.0) -> DataFrame:
    """A CSV with a header; lon and lat must be among its columns."""
    from arborlake.operators.voxel import parse_observations

    raw = spark.read.option("header", True).csv(path)
    if not {"lon", "lat"} <= set(raw.columns):
        raise ValueError(f"{path} needs columns lon and lat")
    for c in ("observation_id", "id", "height_agl"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return parse_observations(raw.withColumn("row_no", F.monotonically_increasing_id()), default_h)


def read_tree_metrics(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tree_metrics`` wrote, with numbers as numbers; a missing table has no rows."""
    from pyspark.errors import AnalysisException

    kinds = {"tree_id": "long", "tile": "string", "n_cylinders": "long", "max_branch_order": "int", "n_branch_orders": "long"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in TREE_METRICS)
    try:
        return spark.read.option("header", True).schema(schema).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_tiles(df: DataFrame, path: str, tile: str = "tile") -> None:
    """One folder for each tile, so that a tile's table is read or replaced alone."""
    df.write.mode("overwrite").partitionBy(tile).parquet(path)


def combine_cylinders(parts: list[DataFrame], path: str) -> None:
    """The cylinders of all tiles in one text table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    write_cylinders(out, path)


def write_tree_metrics(trees: DataFrame, path: str) -> None:
    """CSV of the fixed columns; missing ones stay blank, others are left out."""
    cols = [F.col(c) if c in trees.columns else F.lit(None).cast("string").alias(c) for c in TREE_METRICS]
    trees.select(*cols).write.mode("overwrite").option("header", True).csv(path)
