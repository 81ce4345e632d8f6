"""All named queries of the spatial engine with their DuckDB oracles.

Queries run over whole tables through the views of ``sources.lens``.  Doubles that come from
sums are rounded to 6 digits on both sides, as the order of adding differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import geometry as G
from arborlake.operators import fits, graph, metrics, segment, spatial, terrain, tiling, voxel, wood_paths
from arborlake.operators.ordered import running_totals
from arborlake.operators.short_edges import short_edges
from arborlake.sources import exports, lens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` goes on after the lens unless it begins with SELECT or WITH."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql if sql.startswith(("SELECT", "WITH")) else f"WITH RECURSIVE {lens.SQL.strip()}{sql}"
        return f

    return register


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _at(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return lens.observations(spark, d), lens.points(spark, d), lens.cylinders(spark, d)


# --- voxel queries -----------------------------------------------------------------------

_BOX = """,
bx AS (
  SELECT obs_id, s.size, wx - s.size / 2 AS x0, wx + s.size / 2 AS x1, wy - s.size / 2 AS y0, wy + s.size / 2 AS y1,
    coalesce(h, 2.0::DOUBLE) - s.size / 2 AS z0, coalesce(h, 2.0::DOUBLE) + s.size / 2 AS z1
  FROM obs, (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) s(size)),
pin AS (SELECT bx.obs_id, bx.size, p.* FROM bx JOIN points p ON p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1 AND p.z BETWEEN z0 AND z1),
cin AS (SELECT bx.obs_id, bx.size, c.* FROM bx JOIN cylinders c ON c.sx BETWEEN x0 AND x1 AND c.sy BETWEEN y0 AND y1 AND c.sz BETWEEN z0 AND z1)"""
_DCLASS = "CASE WHEN 2 * radius < 0.01::DOUBLE THEN 0 WHEN 2 * radius < 0.02::DOUBLE THEN 1 WHEN 2 * radius < 0.05::DOUBLE THEN 2 WHEN 2 * radius < 0.1::DOUBLE THEN 3 ELSE 4 END"
_RES = f"""{_BOX},
ps AS (
  SELECT obs_id, size, count(*) AS point_count, count(*) FILTER (segment_label >= 0) AS tree_points, count(*) FILTER (segment_label < 0) AS ground_points,
    count(DISTINCT CASE WHEN segment_label >= 0 THEN segment_label END) AS n_segments
  FROM pin GROUP BY ALL),
cs AS (
  SELECT obs_id, size, count(*) AS cyl_count, avg(radius) AS mean_branch_radius, max(radius) AS max_branch_radius, median(radius) AS median_branch_radius,
    quantile_cont(radius, 0.9) AS p90_branch_radius, coalesce(sum(radius * length) / nullif(sum(length), 0), avg(radius)) AS lw_mean_radius,
    sum(length) AS total_branch_length, max(branch_order) AS max_branch_order, avg(branch_order) AS mean_branch_order,
    {", ".join(f"count(*) FILTER (k = {i}) AS n_d_{c}, coalesce(sum(length) FILTER (k = {i}), 0.0) AS len_d_{c}" for i, c in enumerate(G.DIAMETER_CLASSES))}
  FROM (SELECT *, {_DCLASS} AS k FROM cin) GROUP BY ALL),
res AS (
  SELECT bx.obs_id, bx.size, coalesce(point_count, 0) AS point_count, coalesce(tree_points, 0) AS tree_points, coalesce(ground_points, 0) AS ground_points,
    CASE WHEN point_count > 0 THEN round(tree_points / point_count::DOUBLE, 6) ELSE 0.0::DOUBLE END AS veg_cover, coalesce(n_segments, 0) AS n_segments, coalesce(cyl_count, 0) AS cyl_count,
    {", ".join(f"round({c}, 6) AS {c}" for c in ("mean_branch_radius", "max_branch_radius", "median_branch_radius", "p90_branch_radius", "lw_mean_radius", "mean_branch_order"))},
    round(coalesce(total_branch_length, 0.0), 6)::DOUBLE AS total_branch_length, max_branch_order,
    {", ".join(f"coalesce(n_d_{c}, 0) AS n_d_{c}, round(coalesce(len_d_{c}, 0.0), 6)::DOUBLE AS len_d_{c}" for c in G.DIAMETER_CLASSES)}
  FROM bx LEFT JOIN ps USING (obs_id, size) LEFT JOIN cs USING (obs_id, size))"""


@query("batch_voxel", f"{_RES} SELECT * FROM res")
def _batch(spark: SparkSession, d: str) -> DataFrame:
    return r6(voxel.batch_query(*_at(spark, d)))


@query("batch_voxel_wide", f"{_RES} SELECT obs_id, " + ", ".join(f"max(CASE WHEN size = {s} THEN {c} END) AS r{i}_{c}" for i, s in enumerate((1, 2, 3), 1) for c in voxel.WIDE) + " FROM res GROUP BY obs_id")
def _wide(spark: SparkSession, d: str) -> DataFrame:
    return r6(voxel.widen(voxel.batch_query(*_at(spark, d))))


def _one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 25.0, 20.0, 18.0)], "obs_id long, wx double, wy double, h double")


_SINGLE = """ SELECT count(*) AS point_count, count(*) FILTER (segment_label >= 0) AS tree_points, count(DISTINCT segment_label) FILTER (segment_label >= 0) AS n_segments
 FROM points WHERE x BETWEEN {0} AND {1} AND y BETWEEN {2} AND {3} AND z BETWEEN {4} AND {5}"""


@query("voxel_single", _SINGLE.format(23.0, 27.0, 18.0, 22.0, 16.0, 20.0))
def _single(spark: SparkSession, d: str) -> DataFrame:
    b = voxel.boxes(_one(spark), (4.0,))
    return voxel.query(b, lens.points(spark, d), lens.cylinders(spark, d), 4.0).select("point_count", "tree_points", "n_segments")


@query("voxel_min_corner", _SINGLE.format(25.0, 29.0, 20.0, 24.0, 18.0, 22.0))
def _corner(spark: SparkSession, d: str) -> DataFrame:
    b = voxel.boxes(_one(spark), (4.0,), anchor="min")
    return voxel.query(b, lens.points(spark, d), lens.cylinders(spark, d), 4.0).select("point_count", "tree_points", "n_segments")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    obs, pts, _ = _at(spark, d)
    return voxel.segment_counts(voxel.boxes(obs), pts, 3.0)


@query("voxel_segment_counts", f"{_BOX} SELECT obs_id, size, segment_label, count(*) AS n_points FROM pin WHERE segment_label >= 0 GROUP BY ALL")
def _segments(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


@query("voxel_segment_map", f"{_BOX}, s AS (SELECT obs_id, size, segment_label, count(*) AS n FROM pin WHERE segment_label >= 0 GROUP BY ALL) SELECT obs_id, size, string_agg(segment_label || ':' || n, ',' ORDER BY segment_label) AS segments FROM s GROUP BY ALL")
def _segment_map(spark: SparkSession, d: str) -> DataFrame:
    m = voxel.segment_map(_counts(spark, d))
    return m.select("obs_id", "size", F.array_join(F.transform(F.map_entries("segments"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",").alias("segments"))


@query(
    "voxel_top8_segments",
    f"""{_BOX}, s AS (SELECT obs_id, size, segment_label, count(*) AS n_points FROM pin WHERE segment_label >= 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY obs_id, size ORDER BY n_points DESC, segment_label)::INTEGER AS rank FROM s)
SELECT obs_id, size, rank, segment_label, n_points FROM r WHERE rank <= 8
UNION ALL SELECT obs_id, size, 9, NULL, sum(n_points)::BIGINT FROM r WHERE rank > 8 GROUP BY obs_id, size""",
)
def _top8(spark: SparkSession, d: str) -> DataFrame:
    return voxel.top_segments(_counts(spark, d))


@query("voxel_diameter_classes", f"{_BOX} SELECT obs_id, size, {_DCLASS} AS class_no, count(*) AS n, round(sum(length), 6) AS total_length FROM cin GROUP BY ALL")
def _vclasses(spark: SparkSession, d: str) -> DataFrame:
    obs, _, cyl = _at(spark, d)
    return r6(voxel.cylinders_in(voxel.boxes(obs), cyl, 3.0).groupBy("obs_id", "size", G.diameter_class("radius").alias("class_no")).agg(F.count("*").alias("n"), F.sum("length").alias("total_length")))


@query(
    "obs_defaults",
    """SELECT coalesce(nullif(trim(user_txt), ''), nullif(trim(event_type), ''), 'row_' || event_id) AS observation_id, lon, lat, coalesce(h, 2.0::DOUBLE) AS height_agl
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE user_id::VARCHAR END AS user_txt, CASE WHEN event_id % 2 = 0 THEN ' ' ELSE event_type END AS event_type,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS lon, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (user_id % 90)::DOUBLE END AS lat, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 30)::DOUBLE END AS h FROM events)
WHERE lon IS NOT NULL AND lat IS NOT NULL""",
)
def _obs_defaults(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    raw = lens.table(spark, d, "events").select(
        F.when(i % 3 == 0, "").otherwise(F.col("user_id").cast("string")).alias("observation_id"), F.when(i % 2 == 0, " ").otherwise(F.col("event_type")).alias("id"),
        F.when(i % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("lon"), F.when(i % 11 == 0, "").otherwise((F.col("user_id") % 90).cast("string")).alias("lat"),
        F.when(i % 4 == 0, " ").otherwise((i % 30).cast("string")).alias("height_agl"), i.alias("row_no"),
    )
    return voxel.parse_observations(raw)


# --- cylinders and trees -----------------------------------------------------------------

_VOL = "pi() * radius * radius * length"


@query(
    "cylinder_run_summary",
    f""" SELECT count(*) AS n_cylinders, round(avg(radius * 200), 6) AS mean_diameter_cm, round(median(radius * 200), 6) AS median_diameter_cm, round(avg(length), 6) AS mean_length_m,
  round(sum({_VOL}) * 1000, 6) AS total_volume_l, round(median({_VOL} * 1e6), 6) AS median_volume_ml,
  count(*) FILTER (CASE WHEN radius = 0 THEN 0 ELSE length / (2 * radius) END > 100) AS n_outliers,
  round(coalesce(sum({_VOL}) FILTER (CASE WHEN radius = 0 THEN 0 ELSE length / (2 * radius) END <= 100), 0) * 1000, 6) AS volume_without_outliers_l FROM cylinders""",
)
def _summary(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.run_summary(lens.cylinders(spark, d)))


def _hist_sql(value: str, bins: int, span: str = "SELECT min(v) AS lo, max(v) AS hi FROM v", src: str = "cylinders") -> str:
    return f""", v AS (SELECT {value} AS v FROM {src}), b AS ({span}),
c AS (SELECT least(greatest(floor((v - lo) / (hi - lo) * {bins}), 0), {bins - 1})::INTEGER AS bin, count(*) AS n FROM v, b WHERE v BETWEEN lo AND hi GROUP BY ALL),
g AS (SELECT unnest(range({bins}))::INTEGER AS bin)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / {bins}), 6) AS lower, round(lo + (g.bin + 1) * ((hi - lo) / {bins}), 6) AS upper, coalesce(n, 0) AS n FROM b, g LEFT JOIN c USING (bin)"""


@query("cylinder_diameter_hist", _hist_sql("radius * 200", 30))
def _dhist(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.histogram(lens.cylinders(spark, d).withColumn("d", F.col("radius") * 200), "d", 30))


@query("cylinder_length_hist", _hist_sql("length", 30))
def _lhist(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.histogram(lens.cylinders(spark, d), "length", 30))


@query("zenith_hist", _hist_sql("degrees(acos(least(abs(az), 1.0)))", 18, "SELECT 0::DOUBLE AS lo, 90::DOUBLE AS hi"))
def _zhist(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.histogram(lens.cylinders(spark, d).withColumn("zen", G.zenith("az")), "zen", 18, 0, 90))


@query("diameter_classes", f""" SELECT g.k::INTEGER AS class_no, (['lt1cm', '1to2cm', '2to5cm', '5to10cm', 'gt10cm'])[g.k + 1] AS class_name, count(c.k) AS n, round(coalesce(sum(length), 0.0), 6)::DOUBLE AS total_length
FROM (SELECT unnest(range(5)) AS k) g LEFT JOIN (SELECT *, {_DCLASS} AS k FROM cylinders) c ON g.k = c.k GROUP BY ALL""")
def _dclasses(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.diameter_classes(lens.cylinders(spark, d)))


@query("radius_classes", """ SELECT g.k AS class_name, count(c.k) AS n, round(coalesce(sum(length), 0.0), 6)::DOUBLE AS total_length FROM (SELECT unnest(['twig', 'small', 'med', 'large']) AS k) g
LEFT JOIN (SELECT length, CASE WHEN radius <= 0 THEN 'large' WHEN radius <= 0.02::DOUBLE THEN 'twig' WHEN radius <= 0.05::DOUBLE THEN 'small' WHEN radius <= 0.1::DOUBLE THEN 'med' ELSE 'large' END AS k FROM cylinders) c ON g.k = c.k GROUP BY ALL""")
def _rclasses(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.radius_classes(lens.cylinders(spark, d)))


@query("branch_order_dist", " SELECT g.k::INTEGER AS branch_order, count(c.branch_order) AS n FROM (SELECT unnest(range((SELECT max(branch_order) + 1 FROM cylinders))) AS k) g LEFT JOIN cylinders c ON c.branch_order = g.k GROUP BY ALL")
def _orders(spark: SparkSession, d: str) -> DataFrame:
    return metrics.branch_orders(lens.cylinders(spark, d))


@query("trunk_split", f" SELECT CASE WHEN branch_order = (SELECT min(branch_order) FROM cylinders) THEN 'trunk' ELSE 'branch' END AS part, count(*) AS n, round(sum({_VOL}) * 1000, 6) AS volume_l, round(sum(length), 6) AS total_length FROM cylinders GROUP BY ALL")
def _trunk(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.trunk_split(lens.cylinders(spark, d)))


@query("slender_outliers", " SELECT cyl_id, round(length / (2 * radius), 6) AS slenderness FROM cylinders WHERE radius <> 0 AND length / (2 * radius) > 30")
def _slender(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.slender_outliers(lens.cylinders(spark, d), 30.0))


_TREES = f""",
t0 AS (SELECT *, sz + az / greatest(sqrt(ax * ax + ay * ay + az * az), 1e-9) * length AS ez, {_VOL} * 1000 AS v FROM cylinders),
t1 AS (SELECT *, min(least(sz, ez)) OVER w AS fz, branch_order = min(branch_order) OVER w AS trunk FROM t0 WINDOW w AS (PARTITION BY tree_id)),
trees AS (
  SELECT tree_id, count(*) AS n_cylinders, max(greatest(sz, ez)) - min(fz) AS height_m,
    arg_min(radius * 200, (abs((sz + ez) / 2 - fz - 1.3::DOUBLE), cyl_id)) FILTER (trunk) AS dbh, arg_min(radius * 200, (sz, cyl_id)) FILTER (trunk) AS basal_diam_cm,
    sum(v) AS total_volume_l, coalesce(sum(v) FILTER (trunk), 0) AS trunk_volume_l, coalesce(sum(v) FILTER (NOT trunk), 0) AS branch_volume_l, max(branch_order) AS max_branch_order,
    count(DISTINCT branch_order) FILTER (NOT trunk) AS n_branch_orders
  FROM t1 GROUP BY tree_id)"""


@query("tree_metrics", f"""{_TREES} SELECT tree_id, n_cylinders, round(height_m, 6) AS height_m, round(basal_diam_cm, 6) AS basal_diam_cm, round(total_volume_l, 6) AS total_volume_l, round(trunk_volume_l, 6) AS trunk_volume_l,
  round(branch_volume_l, 6) AS branch_volume_l, max_branch_order, n_branch_orders, CASE WHEN height_m >= 1.3 THEN round(dbh, 6) END AS dbh_cm FROM trees""")
def _trees(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.tree_metrics(lens.cylinders(spark, d)))


@query("tree_summary", f"{_TREES} SELECT count(*) AS n_trees, round(median(height_m), 6) AS median_height_m, round(median(CASE WHEN height_m >= 1.3 THEN dbh END), 6) AS median_dbh_cm, round(sum(total_volume_l), 6) AS total_volume_l FROM trees")
def _tsummary(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.tree_summary(metrics.tree_metrics(lens.cylinders(spark, d))))


@query("branch_table", f""" SELECT tree_id, branch_order, count(*) AS n_cylinders, round(sum({_VOL}) * 1000, 6) AS volume_l, round(sum(radius * length * (2 * pi())), 6) AS area_m2, round(sum(length), 6) AS total_length,
  round(max(radius) * 200, 6) AS max_diameter_cm, round(max(greatest(sz, ez)) - min(least(sz, ez)), 6) AS height_m
FROM (SELECT *, sz + az / greatest(sqrt(ax * ax + ay * ay + az * az), 1e-9) * length AS ez FROM cylinders) GROUP BY ALL""")
def _branches(spark: SparkSession, d: str) -> DataFrame:
    return r6(segment.branches(lens.cylinders(spark, d)))


@query("click_volume", f""", c AS (SELECT *, sx + ax / greatest(sqrt(ax*ax+ay*ay+az*az), 1e-9) * length AS ex, sy + ay / greatest(sqrt(ax*ax+ay*ay+az*az), 1e-9) * length AS ey, sz + az / greatest(sqrt(ax*ax+ay*ay+az*az), 1e-9) * length AS ez FROM cylinders),
k AS (SELECT obs_id, wx, wy, coalesce(h, 2.0::DOUBLE) AS wz FROM obs),
hit AS (SELECT DISTINCT obs_id, cyl_id, {_VOL} AS v FROM k JOIN c ON least(sqrt((wx-sx)*(wx-sx)+(wy-sy)*(wy-sy)+(wz-sz)*(wz-sz)), sqrt((wx-ex)*(wx-ex)+(wy-ey)*(wy-ey)+(wz-ez)*(wz-ez))) < 2.5)
SELECT obs_id AS click_id, count(cyl_id) AS n_cylinders, round(coalesce(sum(v), 0.0), 6)::DOUBLE AS volume_m3 FROM k LEFT JOIN hit USING (obs_id) GROUP BY obs_id""")
def _click(spark: SparkSession, d: str) -> DataFrame:
    obs = lens.observations(spark, d).select(F.col("obs_id").alias("click_id"), F.col("wx").alias("cx"), F.col("wy").alias("cy"), F.coalesce("h", F.lit(2.0)).alias("cz"))
    return r6(metrics.click_volume(obs, lens.cylinders(spark, d), 2.5))


@query("cylinder_ends", " SELECT cyl_id, round(sx + ax / greatest(sqrt(ax*ax+ay*ay+az*az), 1e-9) * length, 6) AS ex, round(sy + ay / greatest(sqrt(ax*ax+ay*ay+az*az), 1e-9) * length, 6) AS ey, round(sz + az / greatest(sqrt(ax*ax+ay*ay+az*az), 1e-9) * length, 6) AS ez, round(sx + ax * length / 2, 6) AS mx, round(sy + ay * length / 2, 6) AS my, round(sz + az * length / 2, 6) AS mz FROM cylinders")
def _ends(spark: SparkSession, d: str) -> DataFrame:
    s, a = ["sx", "sy", "sz"], ["ax", "ay", "az"]
    e, m = G.cylinder_end(s, a, "length"), G.cylinder_centre(s, a, "length")
    return r6(lens.cylinders(spark, d).select("cyl_id", *[c.alias(n) for c, n in zip([*e, *m], ["ex", "ey", "ez", "mx", "my", "mz"])]))


@query("cylinder_basis", None)
def _basis(spark: SparkSession, d: str) -> DataFrame:
    u, v = G.basis(["ax", "ay", "az"])
    a: list[Column | str] = ["ax", "ay", "az"]
    return lens.cylinders(spark, d).select("cyl_id", (F.round(G.dot(u, a), 9) + 0.0).alias("ua"), (F.round(G.dot(v, a), 9) + 0.0).alias("va"), (F.round(G.dot(u, v), 9) + 0.0).alias("uv"), F.round(G.norm(*u), 9).alias("u_len"))


@query("axis_angles", " SELECT cyl_id, round(acos(least(abs(az / greatest(sqrt(ax*ax+ay*ay+az*az), 1e-9)), 1.0)), 6) AS lean, round(CASE WHEN abs((radius - 0.06) / (0.01 * 6)) < 1 THEN pow(1 - ((radius - 0.06) / (0.01 * 6)) * ((radius - 0.06) / (0.01 * 6)), 2) ELSE 0 END, 6) AS weight, round(abs((sx - 25) * ax + (sy - 25) * ay + (sz - 25) * az), 6) AS plane_residual FROM cylinders")
def _angles(spark: SparkSession, d: str) -> DataFrame:
    a: list[Column | str] = ["ax", "ay", "az"]
    c = lens.cylinders(spark, d)
    mid = [F.lit(25.0)] * 3
    return r6(c.select("cyl_id", G.fold_angle(a, [F.lit(0.0), F.lit(0.0), F.lit(1.0)]).alias("lean"), G.tukey_weight(F.col("radius") - 0.06, F.lit(0.01)).alias("weight"), G.plane_residual(["sx", "sy", "sz"], mid, a).alias("plane_residual")))


@query("color_rank", " SELECT segment_label, round((row_number() OVER (ORDER BY segment_label) - 0.5) / count(*) OVER (), 6) AS shade FROM (SELECT DISTINCT segment_label FROM points WHERE segment_label >= 0)")
def _shade(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.color_rank(lens.points(spark, d).where("segment_label >= 0"), "segment_label"))


@query("confusion_metrics", """, e AS (SELECT segment_label >= 5 AS t, intensity > 30000 AS p FROM points),
c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM e),
k AS (SELECT *, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS acc, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + fn + tn)::DOUBLE * (tp + fp + fn + tn)) AS ch FROM c)
SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision_pos, round(tp / (tp + fn)::DOUBLE, 6) AS recall_pos, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1_pos, round(tn / (tn + fn)::DOUBLE, 6) AS precision_neg,
  round(tn / (tn + fp)::DOUBLE, 6) AS recall_neg, round(2.0::DOUBLE * tn / (2 * tn + fn + fp), 6) AS f1_neg, round(acc, 6) AS accuracy, round((acc - ch) / (1 - ch), 6) AS kappa FROM k""")
def _confusion(spark: SparkSession, d: str) -> DataFrame:
    e = lens.points(spark, d).select((F.col("segment_label") >= 5).cast("int").alias("t"), (F.col("intensity") > 30000).cast("int").alias("p"))
    return r6(metrics.confusion(e, "t", "p"))


@query("best_model", """, c AS (SELECT tree_id % 8 AS model_id, avg(radius) AS mean_radius, max(length) AS max_length, stddev_samp(radius) AS std_radius FROM cylinders GROUP BY 1),
l AS (SELECT model_id, unnest(['mean_radius', 'max_length', 'std_radius']) AS criterion, unnest([mean_radius, max_length, std_radius]) AS value FROM c)
SELECT criterion, arg_min(model_id, (round(value, 6), model_id)) AS model_id, round(min(value), 6) AS value FROM l GROUP BY criterion""")
def _best(spark: SparkSession, d: str) -> DataFrame:
    c = lens.cylinders(spark, d).groupBy((F.col("tree_id") % 8).alias("model_id")).agg(F.avg("radius").alias("mean_radius"), F.max("length").alias("max_length"), F.stddev_samp("radius").alias("std_radius"))
    return metrics.best_models(r6(c.unpivot(["model_id"], ["mean_radius", "max_length", "std_radius"], "criterion", "value")))


@query("model_criteria", None)
def _criteria(spark: SparkSession, d: str) -> DataFrame:
    c = lens.cylinders(spark, d).withColumn("model_id", F.col("tree_id") % 8).withColumn("mad", F.col("radius") / 10).withColumn("surf_cov", F.pmod("cyl_id", F.lit(12)) / 12)
    return r6(metrics.model_criteria(c))


# --- hygiene and tiling ------------------------------------------------------------------

_KEY = ["order_key", "line_no", "intensity", "segment_label", "cover_set"]


def _stats(df: DataFrame, *keys: str, cols: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    return r6(df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in cols]))


def _stats_sql(src: str, keys: str = "", cols: tuple[str, ...] = ("x", "y", "z")) -> str:
    return f"SELECT {keys + ', ' if keys else ''}count(*) AS n, {', '.join(f'round(sum({c}), 6) AS sum_{c}' for c in cols)} FROM {src}" + (f" GROUP BY {keys}" if keys else "")


@query("normalize_xy", " SELECT order_key, line_no, round(x - (SELECT avg(x) FROM points), 6) AS x, round(y - (SELECT avg(y) FROM points), 6) AS y, round(z, 6) AS z FROM points")
def _nxy(spark: SparkSession, d: str) -> DataFrame:
    return r6(tiling.centre(lens.points(spark, d)).select("order_key", "line_no", "x", "y", "z"))


@query("normalize_xyz", " SELECT order_key, line_no, round(x - (SELECT avg(x) FROM points), 6) AS x, round(y - (SELECT avg(y) FROM points), 6) AS y, round(z - (SELECT avg(z) FROM points), 6) AS z FROM points")
def _nxyz(spark: SparkSession, d: str) -> DataFrame:
    return r6(tiling.centre(lens.points(spark, d), True).select("order_key", "line_no", "x", "y", "z"))


_TILE = ", o AS (SELECT min(x) AS x0, min(y) AS y0, greatest(ceil((max(x) - min(x)) / 10), 1) AS nx, greatest(ceil((max(y) - min(y)) / 10), 1) AS ny FROM points)"


@query("tile_assign_halfopen", _TILE + ", t AS (SELECT least(floor((x - x0) / 10), nx - 1)::INTEGER AS tx, least(floor((y - y0) / 10), ny - 1)::INTEGER AS ty, z FROM points, o) SELECT tx, ty, count(*) AS n, round(sum(z), 6) AS sum_z FROM t GROUP BY ALL")
def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spatial.assign_tiles(lens.points(spark, d), 10.0), "tx", "ty", cols=("z",))


@query("tile_assign_closed", _TILE + ", g AS (SELECT i::INTEGER AS tx, j::INTEGER AS ty FROM o, unnest(range(nx::BIGINT)) a(i), unnest(range(ny::BIGINT)) b(j)) SELECT tx, ty, count(*) AS n, round(sum(z), 6) AS sum_z FROM points, o, g WHERE x BETWEEN x0 + tx * 10 AND x0 + (tx + 1) * 10 AND y BETWEEN y0 + ty * 10 AND y0 + (ty + 1) * 10 GROUP BY ALL")
def _tiles_closed(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spatial.assign_tiles(lens.points(spark, d), 10.0, closed_edges=True), "tx", "ty", cols=("z",))


@query("tile_bbox", _TILE + ", t AS (SELECT least(floor((x - x0) / 10), nx - 1)::INTEGER AS tx, least(floor((y - y0) / 10), ny - 1)::INTEGER AS ty, x, y, z FROM points, o) SELECT tx, ty, round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1, round(min(z), 6) AS z0, round(max(z), 6) AS z1, count(*) AS n_points FROM t GROUP BY ALL")
def _bbox(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.extent(spatial.assign_tiles(lens.points(spark, d), 10.0), "tx", "ty"))


@query("dedup_xyz", ", q AS (SELECT x, y, (z * 50 / 400)::INTEGER AS z, order_key, line_no, intensity, segment_label, cover_set FROM points), r AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY order_key, line_no, intensity, segment_label, cover_set) AS k FROM (SELECT x, floor(y) AS y, z, order_key, line_no, intensity, segment_label, cover_set FROM q)) SELECT x, y, z::DOUBLE AS z, order_key, line_no, round(intensity, 6) AS intensity, segment_label, cover_set FROM r WHERE k = 1")
def _dedup(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d).withColumn("y", F.floor("y").cast("double")).withColumn("z", F.bround(F.col("z") * 50 / 400).cast("double"))
    return r6(tiling.dedup(p, _KEY))


@query("recombine_nonempty", " SELECT count(*) AS n, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y, round(sum(z), 6) AS sum_z FROM points WHERE segment_label < 5")
def _recombine(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d)
    return _stats(tiling.recombine([p.where("segment_label < 2"), p.where("segment_label > 99"), p.where("segment_label between 2 and 4")]))


_T5 = ", t AS (SELECT (floor(x / 10))::INTEGER AS tile, * FROM points)"


@query("label_offsets", _T5 + ", m AS (SELECT tile, max(CASE WHEN segment_label >= 0 THEN segment_label + 1 ELSE 0 END) AS k FROM t GROUP BY tile), o AS (SELECT tile, coalesce(sum(k) OVER (ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM m) SELECT tile, (CASE WHEN segment_label >= 0 THEN segment_label + o ELSE segment_label END)::BIGINT AS segment_label, count(*) AS n FROM t JOIN o USING (tile) GROUP BY ALL")
def _offsets(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d).withColumn("tile", F.floor(F.col("x") / 10).cast("int"))
    return tiling.label_offsets(p, "tile").groupBy("tile", "segment_label").agg(F.count("*").alias("n"))


@query("global_tree_ids", _T5 + " SELECT tile, segment_label, row_number() OVER (ORDER BY tile, segment_label) - 1 AS global_id FROM (SELECT DISTINCT tile, segment_label FROM t WHERE segment_label >= 0)")
def _gids(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d).withColumn("tile", F.floor(F.col("x") / 10).cast("int")).where("segment_label >= 0")
    return tiling.global_ids(p, "tile", "segment_label")


@query("intensity_filter", " " + _stats_sql("points WHERE intensity > 32767.5"))
def _intensity(spark: SparkSession, d: str) -> DataFrame:
    return _stats(lens.points(spark, d).where(F.col("intensity") > 32767.5))


@query("intensity_rescale", " SELECT order_key, line_no, round((intensity - (SELECT min(intensity) FROM points)) / ((SELECT max(intensity) FROM points) - (SELECT min(intensity) FROM points)) * 65535.0::DOUBLE, 6) AS scaled FROM points")
def _rescale(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d)
    span = F.broadcast(p.agg(F.min("intensity").alias("lo"), F.max("intensity").alias("hi")))
    return r6(p.crossJoin(span).select("order_key", "line_no", G.rescale("intensity", "lo", "hi").alias("scaled")))


@query("min_segment_size", ", s AS (SELECT segment_label, count(*) AS n FROM points WHERE segment_label >= 0 GROUP BY 1), g AS (SELECT avg(n) AS m FROM s) SELECT segment_label, n FROM s, g WHERE n >= 100")
def _minseg(spark: SparkSession, d: str) -> DataFrame:
    return tiling.min_segment(lens.points(spark, d), 100).groupBy("segment_label").agg(F.count("*").alias("n"))


@query("noise_percentile", " " + _stats_sql("points WHERE intensity >= (SELECT quantile_cont(intensity, 0.05) FROM points)"))
def _noise(spark: SparkSession, d: str) -> DataFrame:
    return _stats(tiling.percentile_filter(lens.points(spark, d), "intensity", 5))


@query("mm_join_first_wins", ", f AS (SELECT round_even(x * 1000, 0)::BIGINT AS kx, round_even(floor(y) * 1000, 0)::BIGINT AS ky, arg_min(intensity, (order_key, line_no, z, intensity)) AS v FROM points WHERE segment_label >= 5 GROUP BY ALL) SELECT p.order_key, p.line_no, round(p.z, 6) AS z, round(f.v, 6) AS field_intensity FROM points p LEFT JOIN f ON round_even(p.x * 1000, 0)::BIGINT = kx AND round_even(floor(p.y) * 1000, 0)::BIGINT = ky WHERE p.segment_label < 0")
def _mm(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d).withColumn("y", F.floor("y").cast("double"))
    j = tiling.mm_join(p.where("segment_label < 0"), p.where("segment_label >= 5"), ["intensity"], ["order_key", "line_no", "z", "intensity"])
    return r6(j.select("order_key", "line_no", "z", "field_intensity"))


@query("semi_mask", ", m AS (SELECT DISTINCT x, y, z FROM points WHERE segment_label = 3) " + _stats_sql("points p SEMI JOIN m USING (x, y, z)", "segment_label"))
def _semi(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d)
    return _stats(p.join(p.where("segment_label = 3").select("x", "y", "z"), ["x", "y", "z"], "left_semi"), "segment_label")


@query("anti_mask", " SELECT DISTINCT cover_set FROM points WHERE segment_label = 1 AND cover_set NOT IN (SELECT cover_set FROM points WHERE segment_label = 2 AND intensity > 40000)")
def _anti(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d)
    return p.where("segment_label = 1").select("cover_set").distinct().join(p.where("segment_label = 2 and intensity > 40000").select("cover_set"), "cover_set", "left_anti")


@query("intersect_labels", " SELECT cover_set FROM points WHERE segment_label = 1 INTERSECT SELECT cover_set FROM points WHERE segment_label = 2")
def _intersect(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d)
    return p.where("segment_label = 1").select("cover_set").intersect(p.where("segment_label = 2").select("cover_set"))


@query("sampled_points", ", r AS (SELECT *, row_number() OVER (ORDER BY order_key, line_no, x, y, z, intensity, segment_label, cover_set) - 1 AS row_no FROM points) SELECT row_no, order_key, line_no FROM r WHERE row_no % (SELECT greatest(ceil(count(*) / 500.0), 1)::BIGINT FROM points) = 0")
def _sampled(spark: SparkSession, d: str) -> DataFrame:
    r = running_totals(lens.points(spark, d), [F.col(c) for c in ("order_key", "line_no", "x", "y", "z", "intensity", "segment_label", "cover_set")])
    return tiling.stride_sample(r, "row_no", 500).select("row_no", "order_key", "line_no")


@query("voxel_subsample", " SELECT count(*) AS n FROM (SELECT DISTINCT floor(x / 2), floor(y / 2), floor(z / 2) FROM points)")
def _subsample(spark: SparkSession, d: str) -> DataFrame:
    return tiling.first_per_voxel(lens.points(spark, d), 2.0, _KEY).agg(F.count("*").alias("n"))


@query("random_cap", None)
def _cap(spark: SparkSession, d: str) -> DataFrame:
    whole = lambda c, k: F.bround(F.col(c) * k).cast("long")
    return tiling.hash_sample(lens.points(spark, d), [F.col("order_key"), F.col("line_no"), whole("x", 100), whole("y", 1e6), whole("z", 50)], 200)


@query("safe_names", r"SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(p_name || ' (v.' || p_size || ')', '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'run') AS stem FROM part")
def _safe(spark: SparkSession, d: str) -> DataFrame:
    p = lens.table(spark, d, "part")
    return p.select("p_partkey", G.safe_name(F.concat("p_name", F.lit(" (v."), F.col("p_size").cast("string"), F.lit(")"))).alias("stem"))


@query("initcap_dims", "SELECT event_id, array_to_string(list_transform(string_split(replace(event_type || '_x dim', '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM events")
def _title(spark: SparkSession, d: str) -> DataFrame:
    return lens.table(spark, d, "events").select("event_id", G.title_name(F.concat("event_type", F.lit("_x dim"))).alias("title"))


@query("number_text", " SELECT obs_id, coalesce(printf('%.6f', h), '') AS h_text, printf('%.6f', wx) AS x_text FROM obs")
def _ntext(spark: SparkSession, d: str) -> DataFrame:
    return lens.observations(spark, d).select("obs_id", F.when(F.col("h").isNull(), "").otherwise(G.number_text("h")).alias("h_text"), G.number_text("wx").alias("x_text"))


@query("world_to_norm", " SELECT obs_id, round(wx - 25.0, 6) AS x, round(wy - 24.5, 6) AS y, round(CASE WHEN h IS NULL THEN 0.0 ELSE h - 3.25 END, 6)::DOUBLE AS z FROM obs")
def _w2n(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = G.world_to_norm("wx", "wy", "h", (25.0, 24.5, 3.25))
    return r6(lens.observations(spark, d).select("obs_id", x.alias("x"), y.alias("y"), z.alias("z")))


@query("utm_project", None)
def _utm(spark: SparkSession, d: str) -> DataFrame:
    e, n = G.utm(F.col("wx") / 10 + 8, F.col("wy") + 1, 32632)
    return lens.observations(spark, d).select("obs_id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


# --- terrain -----------------------------------------------------------------------------

_G = ", gr AS (SELECT * FROM points WHERE segment_label < 0)"


def _ground(p: DataFrame) -> DataFrame:
    return p.where("segment_label < 0")


@query("raster_max", " SELECT floor(x / 2)::INTEGER AS ix, floor(y / 2)::INTEGER AS iy, round(max(z), 6) AS z FROM points GROUP BY ALL")
def _raster(spark: SparkSession, d: str) -> DataFrame:
    return r6(terrain.raster_max(lens.points(spark, d), 2.0))


@query("ground_p95", _G + " SELECT floor(x / 2)::INTEGER AS ix, floor(y / 2)::INTEGER AS iy, round(quantile_cont(z, 0.95), 6) AS z FROM gr GROUP BY ALL")
def _p95(spark: SparkSession, d: str) -> DataFrame:
    return r6(terrain.ground_level(_ground(lens.points(spark, d)), 2.0))


_FILL = _G + """, kn AS (SELECT floor(x)::INTEGER AS ix, floor(y)::INTEGER AS iy, max(z) AS z FROM gr WHERE cover_set < 40 GROUP BY ALL),
wa AS (SELECT DISTINCT floor(x)::INTEGER AS ix, floor(y)::INTEGER AS iy FROM points),
fi AS (SELECT wa.ix, wa.iy, arg_min(kn.z, ((wa.ix - kn.ix) * (wa.ix - kn.ix) + (wa.iy - kn.iy) * (wa.iy - kn.iy), kn.ix, kn.iy)) AS z FROM wa, kn GROUP BY ALL)"""


def _known(p: DataFrame) -> DataFrame:
    return terrain.raster_max(_ground(p).where("cover_set < 40"), 1.0)


@query("gap_fill_nearest", _FILL + " SELECT ix, iy, round(z, 6) AS z FROM fi")
def _fill(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d)
    return r6(terrain.fill_nearest(_known(p), p.select(*terrain.grid_cell(1.0))))


@query("subtract_terrain", _FILL + " SELECT order_key, line_no, round(p.z - fi.z, 6) AS z FROM points p JOIN fi ON floor(x)::INTEGER = ix AND floor(y)::INTEGER = iy")
def _subtract(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d)
    return r6(terrain.subtract(p, _known(p), 1.0).select("order_key", "line_no", "z"))


@query("under_ground_filter", _G + """, kn AS (SELECT floor(x / 2)::INTEGER AS ix, floor(y / 2)::INTEGER AS iy, quantile_cont(z, 0.95) AS z FROM gr GROUP BY ALL),
wa AS (SELECT DISTINCT floor(x / 2)::INTEGER AS ix, floor(y / 2)::INTEGER AS iy FROM points),
fi AS (SELECT wa.ix, wa.iy, arg_min(kn.z, ((wa.ix - kn.ix) * (wa.ix - kn.ix) + (wa.iy - kn.iy) * (wa.iy - kn.iy), kn.ix, kn.iy)) AS z FROM wa, kn GROUP BY ALL)
SELECT segment_label, count(*) AS n, round(sum(p.z), 6) AS sum_z FROM points p JOIN fi ON floor(x / 2)::INTEGER = ix AND floor(y / 2)::INTEGER = iy WHERE p.z > fi.z + 0.2003::DOUBLE GROUP BY ALL""")
def _under(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d)
    # The offset keeps off the grid of the heights, where interpolated percentiles round apart.
    return _stats(terrain.above_ground(p, _ground(p), 0.2003, 2.0), "segment_label", cols=("z",))


@query("lite_ground_filter", " " + _stats_sql("points WHERE segment_label >= 0 AND z > (SELECT avg(z) FROM points WHERE segment_label < 0)", "segment_label"))
def _lite(spark: SparkSession, d: str) -> DataFrame:
    return _stats(terrain.above_mean_ground(lens.points(spark, d), F.col("segment_label") < 0), "segment_label")


@query("dense_band", """, bo AS (SELECT min(z) AS z0, (max(x) - min(x)) * (max(y) - min(y)) AS a FROM points), b AS (SELECT floor((z - z0) / 0.5)::BIGINT AS band, count(*) AS n FROM points, bo GROUP BY ALL),
m AS (SELECT coalesce(min(band) FILTER (n > a * 0.1), arg_min(band, (-n, band))) AS band FROM b, bo) SELECT band, round(z0 + (band + 1) * 0.5, 6) AS band_top FROM m, bo""")
def _dense(spark: SparkSession, d: str) -> DataFrame:
    return r6(terrain.densest_band(lens.points(spark, d), 0.5, 0.1))


@query("cloth_ground", None)
def _cloth(spark: SparkSession, d: str) -> DataFrame:
    return terrain.cloth_ground(lens.points(spark, d)).groupBy("is_ground").agg(F.count("*").alias("n"))


# --- neighbours, graphs, clusters --------------------------------------------------------

def _vectors(spark: SparkSession, d: str, s: str = "") -> DataFrame:
    e = F.col("embedding")
    return lens.table(spark, d, "embeddings").select(F.col("vec_id").alias(f"id{s}"), *[e[i].cast("double").alias(f"{c}{s}") for i, c in enumerate("xyz")], F.col("label").alias(f"label{s}"))


_E = "v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_XA, _XB = ["xa", "ya", "za"], ["xb", "yb", "zb"]


def _pairs(spark: SparkSession, d: str, r: float) -> DataFrame:
    a, b = (_vectors(spark, d, s).drop(f"label{s}") for s in "ab")
    return spatial.dealt_radius_pairs(a, b, r, _XA, _XB, F.col("ida") != F.col("idb"))


@query("radius_neighbors", f"WITH {_E} SELECT a.id AS ida, b.id AS idb, round(sqrt({_D2}), 6) AS distance FROM v a, v b WHERE a.id <> b.id AND {_D2} <= 0.3::DOUBLE * 0.3::DOUBLE")
def _radius(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, 0.3).select("ida", "idb", G.round6(F.sqrt("d2")).alias("distance"))


@query("hybrid_neighbors", f"WITH {_E}, n AS (SELECT a.id AS ida, b.id AS idb, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id)::INTEGER AS rank FROM v a, v b WHERE {_D2} <= 0.5::DOUBLE * 0.5::DOUBLE) SELECT * FROM n WHERE rank <= 20")
def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return spatial.hybrid_pairs(_vectors(spark, d, "a"), _vectors(spark, d, "b"), 0.5, 20, _XA, _XB, "ida", "idb").select("ida", "idb", "rank")


@query("knn", f"WITH {_E}, n AS (SELECT a.id AS ida, b.id AS idb, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id)::INTEGER AS rank FROM v a, v b WHERE a.id <> b.id) SELECT * FROM n WHERE rank <= 6")
def _knn(spark: SparkSession, d: str) -> DataFrame:
    return spatial.knn(_vectors(spark, d, "a"), _vectors(spark, d, "b"), 6, _XA, _XB, "ida", "idb", 0.25).select("ida", "idb", "rank")


@query("nearest_match_tol", f"WITH {_E}, n AS (SELECT a.id AS ida, arg_min(b.id, ({_D2}, b.id)) AS idb, round(sqrt(min({_D2})), 6) AS distance FROM v a, v b WHERE a.label < 5 AND b.label >= 5 AND {_D2} <= 0.4::DOUBLE * 0.4::DOUBLE GROUP BY a.id) SELECT * FROM n")
def _tol(spark: SparkSession, d: str) -> DataFrame:
    return r6(spatial.nearest_within(_vectors(spark, d, "a").where("labela < 5"), _vectors(spark, d, "b").where("labelb >= 5"), 0.4, _XA, _XB, "ida", "idb"))


@query("cover_set_min", " SELECT cover_set, round(min(x), 6) AS x, round(min(y), 6) AS y, round(min(z), 6) AS z FROM points WHERE cover_set >= 0 GROUP BY cover_set")
def _csmin(spark: SparkSession, d: str) -> DataFrame:
    return r6(segment.set_minima(lens.points(spark, d)))


@query("segment_lowest", " SELECT segment_label, arg_min(order_key, (z, order_key)) AS order_key, round(min(z), 6) AS z FROM points GROUP BY segment_label")
def _lowest(spark: SparkSession, d: str) -> DataFrame:
    return r6(segment.lowest_points(lens.points(spark, d), "segment_label", "order_key"))


@query("layer_index", """, l AS (SELECT z, (z - 2.0) / 4.0 AS k FROM points), m AS (SELECT CASE WHEN z > 0 AND z < 2.0 THEN 0 WHEN z > 2.0 AND k <> floor(k) THEN floor(k)::INTEGER + 1 END AS layer FROM l) SELECT layer, count(*) AS n FROM m GROUP BY ALL""")
def _layers(spark: SparkSession, d: str) -> DataFrame:
    return lens.points(spark, d).groupBy(tiling.layer_index(F.col("z"), 0.0, 2.0, 4.0).alias("layer")).agg(F.count("*").alias("n"))


_BB = "b AS (SELECT cyl_id, sx AS x0, sy AS y0, sz AS z0, sx + 1 + radius * 40 AS x1, sy + 1 + length AS y1, sz + 3 AS z1 FROM cylinders WHERE cyl_id <= 1000000)"
_IN = lambda p, q: " OR ".join(f"({p}.{x} BETWEEN {q}.x0 AND {q}.x1 AND {p}.{y} BETWEEN {q}.y0 AND {q}.y1 AND {p}.{z} BETWEEN {q}.z0 AND {q}.z1)" for x in ("x0", "x1") for y in ("y0", "y1") for z in ("z0", "z1"))


@query("box_overlap", f", {_BB} SELECT p.cyl_id AS cyl_id_a, q.cyl_id AS cyl_id_b FROM b p, b q WHERE p.cyl_id < q.cyl_id AND ({_IN('p', 'q')} OR {_IN('q', 'p')})")
def _overlap(spark: SparkSession, d: str) -> DataFrame:
    c = lens.cylinders(spark, d)
    b = c.select("cyl_id", F.col("sx").alias("x0"), F.col("sy").alias("y0"), F.col("sz").alias("z0"), (F.col("sx") + 1 + F.col("radius") * 40).alias("x1"), (F.col("sy") + 1 + F.col("length")).alias("y1"), (F.col("sz") + 3).alias("z1"))
    return spatial.overlapping_boxes(b, "cyl_id", 5.0)


@query("label_broadcast", ", s AS (SELECT cover_set, (cover_set % 7)::INTEGER AS label FROM (SELECT DISTINCT cover_set FROM points WHERE cover_set >= 0)) " + "SELECT coalesce(label, -1)::INTEGER AS label, count(*) AS n, round(sum(z), 6) AS sum_z FROM points LEFT JOIN s USING (cover_set) GROUP BY ALL")
def _labels(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d)
    s = p.where("cover_set >= 0").select("cover_set").distinct().withColumn("label", (F.col("cover_set") % 7).cast("int"))
    return r6(p.join(s, "cover_set", "left").groupBy(F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count("*").alias("n"), F.sum("z").alias("sum_z")))


_VX = f"""WITH RECURSIVE {_E}, vox AS (SELECT floor(x / 0.5)::INTEGER AS vx, floor(y / 0.5)::INTEGER AS vy, floor(z / 0.5)::INTEGER AS vz, count(*) AS n FROM v GROUP BY ALL),
num AS (SELECT *, row_number() OVER (ORDER BY vx, vy, vz) AS i FROM vox),
ed AS (SELECT a.i AS s, b.i AS t FROM num a, num b WHERE abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1),
re(i, c) AS (SELECT i, i FROM num UNION SELECT ed.t, re.c FROM re JOIN ed ON ed.s = re.i),
cc AS (SELECT i, min(c) AS c FROM re GROUP BY i)"""


@query("voxel_components", f"{_VX} SELECT num.vx, num.vy, num.vz, num.n, r.vx AS cx, r.vy AS cy, r.vz AS cz FROM num JOIN cc USING (i) JOIN num r ON r.i = cc.c")
def _components(spark: SparkSession, d: str) -> DataFrame:
    c = graph.voxel_components(_vectors(spark, d), 0.5)
    return c.select("vx", "vy", "vz", "n", F.col("component.vx").alias("cx"), F.col("component.vy").alias("cy"), F.col("component.vz").alias("cz"))


_SMALL = f"""WITH RECURSIVE {_E}, ed AS (SELECT a.id AS s, b.id AS t, round({_D2}, 9) AS w FROM v a, v b WHERE a.id <> b.id AND {_D2} <= 0.3::DOUBLE * 0.3::DOUBLE)"""


@query("shortest_path", f"""{_SMALL}, h AS (
  SELECT 0 AS k, id AS n, CASE WHEN id < 3 THEN 0.0::DOUBLE END AS dist FROM v
  UNION ALL
  SELECT k + 1, n, min(dist) FROM (
    SELECT h.k, h.n, h.dist FROM h UNION ALL SELECT h.k, ed.t, h.dist + ed.w FROM h JOIN ed ON ed.s = h.n WHERE h.dist IS NOT NULL) WHERE k < 40 GROUP BY k, n)
SELECT n AS node, round(dist, 6) AS dist FROM h WHERE k = 40 AND dist IS NOT NULL""")
def _paths(spark: SparkSession, d: str) -> DataFrame:
    e = short_edges(_vectors(spark, d), 0.3, "id", ["x", "y", "z"]).select("src", "dst", F.round("d2", 9).alias("w"))
    s = _vectors(spark, d).where("id < 3").select(F.col("id").alias("node"), F.col("id").alias("base"))
    return r6(graph.shortest_paths(e, s).select("node", "dist"))


@query("dbscan", f"""{_SMALL}, core AS (SELECT s AS id FROM ed GROUP BY s HAVING count(*) + 1 >= 4), ce AS (SELECT s, t FROM ed WHERE s IN (SELECT id FROM core) AND t IN (SELECT id FROM core)),
re(i, c) AS (SELECT id, id FROM core UNION SELECT ce.t, re.c FROM re JOIN ce ON ce.s = re.i), cc AS (SELECT i, min(c) AS c FROM re GROUP BY i),
bo AS (SELECT ed.s AS i, min(cc.c) AS c FROM ed JOIN cc ON cc.i = ed.t GROUP BY ed.s)
SELECT v.id, coalesce(cc.c, bo.c) AS cluster FROM v LEFT JOIN cc ON cc.i = v.id LEFT JOIN bo ON bo.i = v.id""")
def _dbscan(spark: SparkSession, d: str) -> DataFrame:
    return graph.dbscan(_vectors(spark, d), 0.3, 4, "id", ["x", "y", "z"])


@query("spanning_forest", None)
def _forest(spark: SparkSession, d: str) -> DataFrame:
    e = short_edges(_vectors(spark, d), 0.4, "id", ["x", "y", "z"]).select("src", "dst", F.round("d2", 9).alias("w"))
    return graph.spanning_forest(e)


# --- fits --------------------------------------------------------------------------------

_FIT = """, m AS (SELECT segment_label, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM points GROUP BY 1),
s AS (SELECT segment_label, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * u * u + u * v * v) AS p, sum(v * v * v + v * u * u) AS q
  FROM (SELECT segment_label, mx, my, n, x - mx AS u, y - my AS v FROM points JOIN m USING (segment_label)) GROUP BY 1),
ab AS (SELECT *, (p * vv - q * uv) / (uu * vv - uv * uv) / 2 AS a, (q * uu - p * uv) / (uu * vv - uv * uv) / 2 AS b FROM s),
fit AS (SELECT segment_label, a + mx AS cx, b + my AS cy, sqrt(a * a + b * b + (uu + vv) / n) AS r, n FROM ab)"""


@query("circle_fit_sums", _FIT + " SELECT segment_label, round(cx, 6) AS cx, round(cy, 6) AS cy, round(r, 6) AS r, n FROM fit")
def _circle(spark: SparkSession, d: str) -> DataFrame:
    return r6(fits.circle_fit(lens.points(spark, d), ["segment_label"]))


@query("circle_rmse", _FIT + " SELECT segment_label, round(sqrt(avg(pow(abs(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) - r), 2))), 6) AS rmse, round(sqrt(avg(pow(abs(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) - r), 2))) / any_value(r), 6) AS relative_rmse FROM points JOIN fit USING (segment_label) GROUP BY 1")
def _rmse(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d)
    return r6(fits.circle_rmse(p, fits.circle_fit(p, ["segment_label"]), ["segment_label"]))


@query("covariance_sums", " SELECT segment_label, round(covar_pop(x, x), 6) AS xx, round(covar_pop(y, y), 6) AS yy, round(covar_pop(z, z), 6) AS zz, round(covar_pop(x, y), 6) AS xy, round(covar_pop(x, z), 6) AS xz, round(covar_pop(y, z), 6) AS yz, count(*) AS n FROM points GROUP BY 1")
def _cov(spark: SparkSession, d: str) -> DataFrame:
    return r6(fits.covariance(lens.points(spark, d), ["segment_label"]))


@query("surface_variation", None)
def _curv(spark: SparkSession, d: str) -> DataFrame:
    return r6(fits.curvature(fits.covariance(lens.points(spark, d), ["cover_set"])))


@query("wood_leaf_by_intensity", """, c AS (SELECT cover_set % 9 AS cluster, intensity FROM points WHERE cover_set >= 0), s AS (SELECT cluster, count(*) AS n, median(intensity) AS med, quantile_cont(intensity, 0.25) AS q1 FROM c WHERE cluster > 0 GROUP BY 1),
b AS (SELECT arg_min(cluster, (-n, cluster)) AS big, arg_min(q1, (-n, cluster)) AS q FROM s) SELECT cluster, n, round(med, 6) AS median_intensity, cluster = big OR med >= q AS is_wood FROM s, b""")
def _wood(spark: SparkSession, d: str) -> DataFrame:
    c = lens.points(spark, d).where("cover_set >= 0").withColumn("cluster", F.col("cover_set") % 9)
    return r6(segment.wood_by_intensity(c))


@query("rgi_labels", None)
def _rgi(spark: SparkSession, d: str) -> DataFrame:
    return segment.region_labels(_vectors(spark, d), ["label"], "id", k=10, angle_deg=40.0, curv=0.3, resid=0.5, min_size=3)


@query("cover_sets", None)
def _cover(spark: SparkSession, d: str) -> DataFrame:
    return segment.cover_sets(_vectors(spark, d).drop("label"), "id", 0.4, 0.5, 2)


@query("tree_segments", None)
def _segment_trees(spark: SparkSession, d: str) -> DataFrame:
    p = segment.cover_sets(_vectors(spark, d).drop("label"), "id", 0.3, 0.4, 1)
    low = F.broadcast(p.agg(F.min("z").alias("z0")))
    p = p.crossJoin(low).withColumn("z", F.col("z") - F.col("z0") + 0.001).drop("z0")
    return segment.segment_trees(p, 0.3, 0.8, 0.5)


@query("qsm_cylinders", None)
def _qsm(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d).withColumn("x", F.col("x") / 100).withColumn("y", F.col("y") / 100)
    return r6(segment.fit_cylinders(p.withColumn("segment_label", F.col("cover_set") % 20), layer=10.0, voxel=1.0))


# --- paths and sequences -----------------------------------------------------------------

_ORD = ["order_key", "line_no", "x", "y", "z", "intensity", "cover_set"]


@query("equal_regions", """, r AS (SELECT segment_label, z, row_number() OVER (PARTITION BY segment_label ORDER BY order_key, line_no, x, y, z, intensity, cover_set) - 1 AS k, count(*) OVER (PARTITION BY segment_label) // 4 AS size FROM points)
SELECT segment_label, (CASE WHEN k // nullif(size, 0) < 4 THEN k // nullif(size, 0) END)::INTEGER AS region, count(*) AS n, round(sum(z), 6) AS sum_z FROM r GROUP BY ALL""")
def _regions(spark: SparkSession, d: str) -> DataFrame:
    return _stats(wood_paths.equal_regions(lens.points(spark, d), ["segment_label"], _ORD, 4), "segment_label", "region", cols=("z",))


@query("bend_flags", """, a AS (SELECT tree_id, cyl_id, ax, ay, az, lag(ax) OVER w AS px, lag(ay) OVER w AS py, lag(az) OVER w AS pz FROM cylinders WINDOW w AS (PARTITION BY tree_id ORDER BY cyl_id)),
f AS (SELECT tree_id, cyl_id, coalesce((acos(least(greatest((ax*px+ay*py+az*pz) / (sqrt(ax*ax+ay*ay+az*az) * sqrt(px*px+py*py+pz*pz)), -1.0), 1.0)) > 1.8)::INTEGER, 0) AS f FROM a)
SELECT tree_id, cyl_id, max(f) OVER (PARTITION BY tree_id ORDER BY cyl_id ROWS UNBOUNDED PRECEDING) AS bent FROM f""")
def _bends(spark: SparkSession, d: str) -> DataFrame:
    return wood_paths.bend_flags(lens.cylinders(spark, d), ["tree_id"], ["cyl_id"], ["ax", "ay", "az"], 1.8).select("tree_id", "cyl_id", "bent")


@query("end_means", """, r AS (SELECT *, row_number() OVER (PARTITION BY cover_set ORDER BY z, x, y, z) AS k, count(*) OVER (PARTITION BY cover_set) AS t FROM points), e AS (SELECT *, greatest(floor(t * 0.1::DOUBLE), 1) AS n FROM r)
SELECT cover_set, """ + ", ".join(f"round(avg({c}) FILTER ({cond}), 6) AS {name}_{c}" for name, cond in (("low", "k <= n"), ("high", "k > t - n")) for c in "xyz") + " FROM e GROUP BY cover_set")
def _ends_of_sets(spark: SparkSession, d: str) -> DataFrame:
    return r6(wood_paths.end_means(lens.points(spark, d), ["cover_set"], "z"))


@query("distance_buckets", f"""{_SMALL}, h AS (
  SELECT 0 AS k, id AS n, CASE WHEN id < 3 THEN 0.0::DOUBLE END AS dist FROM v
  UNION ALL
  SELECT k + 1, n, min(dist) FROM (
    SELECT h.k, h.n, h.dist FROM h UNION ALL SELECT h.k, ed.t, h.dist + ed.w FROM h JOIN ed ON ed.s = h.n WHERE h.dist IS NOT NULL) WHERE k < 40 GROUP BY k, n)
SELECT i AS interval, floor(dist / i)::BIGINT AS bucket, count(*) AS n FROM h, (VALUES (0.0313::DOUBLE), (0.0771::DOUBLE)) s(i) WHERE k = 40 AND dist IS NOT NULL GROUP BY ALL""")
def _buckets(spark: SparkSession, d: str) -> DataFrame:
    e = short_edges(_vectors(spark, d), 0.3, "id", ["x", "y", "z"]).select("src", "dst", F.round("d2", 9).alias("w"))
    s = _vectors(spark, d).where("id < 3").select(F.col("id").alias("node"), F.col("id").alias("base"))
    return wood_paths.distance_buckets(graph.shortest_paths(e, s), [0.0313, 0.0771]).groupBy("interval", "bucket").agg(F.count("*").alias("n"))


@query("slab_filter", " " + _stats_sql("points WHERE (x - 10.0) * 0.6 + (y - 10.0) * 0.8 >= 0 AND (x - 10.0) * 0.6 + (y - 10.0) * 0.8 <= 10", "segment_label"))
def _slab(spark: SparkSession, d: str) -> DataFrame:
    return _stats(wood_paths.slab(lens.points(spark, d), [10.0, 10.0, 0.0], [16.0, 18.0, 0.0]), "segment_label")


@query("component_shapes", None)
def _shapes(spark: SparkSession, d: str) -> DataFrame:
    return r6(wood_paths.classify_components(wood_paths.component_shapes(lens.points(spark, d), ["cover_set"])))


@query("skeleton_edges", None)
def _skeleton(spark: SparkSession, d: str) -> DataFrame:
    return r6(wood_paths.skeleton(_vectors(spark, d), "id", 6, 0.25, 3))


# --- exports and small filters -----------------------------------------------------------

_TEXT = ", ".join(f"coalesce(printf('%.6f', {c}), '') AS {c}" if c not in voxel.ZERO_COUNTS and c != "max_branch_order" else f"coalesce({c}::VARCHAR, '') AS {c}" for c in voxel.RESULT)


@query("batch_voxel_text", f"{_RES} SELECT obs_id, size, {_TEXT} FROM res")
def _batch_text(spark: SparkSession, d: str) -> DataFrame:
    return exports.as_text(r6(voxel.batch_query(*_at(spark, d))), ["obs_id", "size"])


@query("grid_denoise", ", c AS (SELECT floor(x / 4) AS a, floor(y / 4) AS b, floor(z / 4) AS e FROM points GROUP BY ALL HAVING count(*) >= 3) " + _stats_sql("points SEMI JOIN c ON floor(x / 4) = a AND floor(y / 4) = b AND floor(z / 4) = e", "segment_label"))
def _grid(spark: SparkSession, d: str) -> DataFrame:
    return _stats(tiling.grid_denoise(lens.points(spark, d), 4.0, 3), "segment_label")


@query("two_nearest_bases", f"WITH {_E}, n AS (SELECT a.id AS ida, b.id AS idb, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id)::INTEGER AS rank FROM v a, v b WHERE a.id <> b.id) SELECT * FROM n WHERE rank <= 2")
def _two(spark: SparkSession, d: str) -> DataFrame:
    return spatial.knn(_vectors(spark, d, "a"), _vectors(spark, d, "b"), 2, _XA, _XB, "ida", "idb", 0.5).select("ida", "idb", "rank")


@query("matched_fields", " SELECT 1::BIGINT AS n_fields, count(*) AS n FROM points WHERE segment_label < 0")
def _matched(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d).withColumn("y", F.floor("y").cast("double")).withColumn("blank", F.lit(0.0))
    j = tiling.drop_unmatched_fields(tiling.mm_join(p.where("segment_label < 0"), p.where("segment_label >= 5"), ["intensity", "blank"], ["order_key", "line_no", "z", "intensity"]))
    return j.agg(F.lit(sum(c.startswith("field_") for c in j.columns)).cast("long").alias("n_fields"), F.count("*").alias("n"))


@query("radius_class_json", " SELECT '{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}' AS json FROM (SELECT g.k, count(c.k) AS n FROM (SELECT unnest(['twig', 'small', 'med', 'large']) AS k) g LEFT JOIN (SELECT CASE WHEN radius <= 0 THEN 'large' WHEN radius <= 0.02::DOUBLE THEN 'twig' WHEN radius <= 0.05::DOUBLE THEN 'small' WHEN radius <= 0.1::DOUBLE THEN 'med' ELSE 'large' END AS k FROM cylinders) c ON g.k = c.k GROUP BY g.k)")
def _json(spark: SparkSession, d: str) -> DataFrame:
    return exports.class_json(metrics.radius_classes(lens.cylinders(spark, d)))


@query("principal_axes", None)
def _axes(spark: SparkSession, d: str) -> DataFrame:
    return r6(fits.principal_axes(fits.covariance(lens.points(spark, d), ["cover_set"]), ["cover_set"]))


from arborlake import catalog_more  # noqa: E402  registers its queries

ORACLE_SQL |= {n: sql if sql.startswith(("SELECT", "WITH")) else f"WITH RECURSIVE {lens.SQL.strip()}{sql}" for n, sql in catalog_more.MORE_SQL.items()}
