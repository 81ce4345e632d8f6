"""The driver's tables seen as a scanned plot: points, cylinders and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, intensity, segment_label, cover_set, order_key, line_no."""
    d = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 2100.0).alias("y"),
        (d / F.lit(50.0)).alias("z"),
        (F.col("l_discount") * 655350.0).alias("intensity"),
        (F.col("l_suppkey") % 12 - 2).cast("int").alias("segment_label"),
        (F.col("l_partkey") % 200 - 1).cast("int").alias("cover_set"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
    )


def cylinders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cyl_id, tree_id, sx, sy, sz, radius, ax, ay, az, length, branch_order."""
    k = F.col("p_partkey")
    at = lambda m: ((k * m) % 5000) / 100.0
    ax, ay, az = (k % 7 - 3).cast("double"), (k % 11 - 5).cast("double"), (k % 5 + 1).cast("double")
    n = F.sqrt(ax * ax + ay * ay + az * az)
    return table(spark, sf_dir, "part").select(
        k.alias("cyl_id"), (k % 40).alias("tree_id"), at(37).alias("sx"), at(91).alias("sy"), at(53).alias("sz"),
        ((F.col("p_size") * 97 + k % 89) / 38903.0).alias("radius"),
        (ax / n).alias("ax"), (ay / n).alias("ay"), (az / n).alias("az"),
        ((F.col("p_retailprice") + k % 83) / 1013.0).alias("length"),
        (k % 5).cast("int").alias("branch_order"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, wx, wy, h (null: the default height)."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        s.alias("obs_id"), (((s * 13) % 500) / 10.0).alias("wx"), (((s * 29) % 500) / 10.0).alias("wy"),
        F.when(s % 7 != 0, ((s * 7) % 300) / 10.0).alias("h"),
    )


#: The same views in DuckDB, as common table expressions.
SQL = """
points AS (
  SELECT l_quantity AS x, l_extendedprice / 2100.0::DOUBLE AS y,
    date_diff('day', DATE '1995-01-01', l_shipdate::DATE) / 50.0::DOUBLE AS z,
    l_discount * 655350.0::DOUBLE AS intensity, (l_suppkey % 12 - 2)::INTEGER AS segment_label,
    (l_partkey % 200 - 1)::INTEGER AS cover_set, l_orderkey AS order_key, l_linenumber AS line_no
  FROM lineitem),
cyl0 AS (
  SELECT p_partkey AS k, p_size, p_retailprice, (p_partkey % 7 - 3)::DOUBLE AS u, (p_partkey % 11 - 5)::DOUBLE AS v, (p_partkey % 5 + 1)::DOUBLE AS w FROM part),
cylinders AS (
  SELECT k AS cyl_id, k % 40 AS tree_id, ((k * 37) % 5000) / 100.0::DOUBLE AS sx, ((k * 91) % 5000) / 100.0::DOUBLE AS sy, ((k * 53) % 5000) / 100.0::DOUBLE AS sz,
    (p_size * 97 + k % 89) / 38903.0::DOUBLE AS radius, u / sqrt(u * u + v * v + w * w) AS ax, v / sqrt(u * u + v * v + w * w) AS ay, w / sqrt(u * u + v * v + w * w) AS az,
    (p_retailprice + k % 83) / 1013.0::DOUBLE AS length, (k % 5)::INTEGER AS branch_order
  FROM cyl0),
obs AS (
  SELECT s_suppkey AS obs_id, ((s_suppkey * 13) % 500) / 10.0::DOUBLE AS wx, ((s_suppkey * 29) % 500) / 10.0::DOUBLE AS wy,
    CASE WHEN s_suppkey % 7 <> 0 THEN ((s_suppkey * 7) % 300) / 10.0::DOUBLE END AS h
  FROM supplier)
"""
