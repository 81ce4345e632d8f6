"""Named queries of the smaller operators, of files written and read again, and of graphs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.catalog import _BOX, _D2, _E, _FILL, _SMALL, _TREES, _XA, _XB, _known, _stats, _stats_sql, _vectors, query, r6
from arborlake.functions import geometry as G
from arborlake.operators import graph, metrics, segment, spatial, terrain, tiling, voxel, wood_paths
from arborlake.operators.kernels import largest_chord
from arborlake.plans.stage import shared_dir
from arborlake.sources import exports, lens, runs

# --- scalars and filters -----------------------------------------------------------------


@query("cylinder_centres", " SELECT cyl_id, round(sx + ax * length / 2, 6) AS mx, round(sy + ay * length / 2, 6) AS my, round(sz + az * length / 2, 6) AS mz FROM cylinders")
def _centres(spark: SparkSession, d: str) -> DataFrame:
    m = G.cylinder_centre(["sx", "sy", "sz"], ["ax", "ay", "az"], "length")
    return r6(lens.cylinders(spark, d).select("cyl_id", *[c.alias(n) for c, n in zip(m, ("mx", "my", "mz"))]))


@query("plane_residuals", " SELECT order_key, line_no, round(abs((x - 25) * 0.6 + (y - 25) * 0.8), 6) AS residual FROM points")
def _plane(spark: SparkSession, d: str) -> DataFrame:
    r = G.plane_residual(["x", "y", "z"], [F.lit(25.0)] * 3, [F.lit(0.6), F.lit(0.8), F.lit(0.0)])
    return r6(lens.points(spark, d).select("order_key", "line_no", r.alias("residual")))


@query("tukey_weights", ", u AS (SELECT cyl_id, (length - 1.5) / (0.25 * 6) AS u FROM cylinders) SELECT cyl_id, round(CASE WHEN abs(u) < 1 THEN pow(1 - u * u, 2) ELSE 0 END, 6) AS weight FROM u")
def _tukey(spark: SparkSession, d: str) -> DataFrame:
    return r6(lens.cylinders(spark, d).select("cyl_id", G.tukey_weight(F.col("length") - 1.5, F.lit(0.25)).alias("weight")))


@query("restore_terrain", " SELECT order_key, line_no, round(z, 6) AS z FROM points")
def _restore(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d)
    return r6(terrain.restore(terrain.subtract(p, _known(p), 1.0)).select("order_key", "line_no", "z"))


@query("thickness_split", " SELECT radius > 0.1::DOUBLE AS thick, count(*) AS n, round(sum(length), 6) AS total_length FROM cylinders WHERE sqrt(ax * ax + ay * ay + az * az) > 1e-9 GROUP BY ALL")
def _thick(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.thickness_split(lens.cylinders(spark, d)).groupBy("thick").agg(F.count("*").alias("n"), F.sum("length").alias("total_length")))


@query("narrow_cylinders", " SELECT cyl_id, round(radius, 6) AS radius FROM cylinders WHERE radius < 0.0401::DOUBLE")
def _narrow(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.without_wide(lens.cylinders(spark, d), 0.0401).select("cyl_id", "radius"))


@query("intensity_factor", " SELECT order_key, line_no, round(intensity / 65535.0::DOUBLE * 2.5::DOUBLE, 6) AS scaled FROM points")
def _factor(spark: SparkSession, d: str) -> DataFrame:
    return r6(lens.points(spark, d).select("order_key", "line_no", G.scale_intensity("intensity", 2.5).alias("scaled")))


@query("cube_sides", "SELECT s_suppkey, round((s_suppkey % 9 + 1) / 3.280839895::DOUBLE, 6) AS side_m FROM supplier")
def _sides_m(spark: SparkSession, d: str) -> DataFrame:
    return r6(lens.table(spark, d, "supplier").select("s_suppkey", G.to_metres(F.col("s_suppkey") % 9 + 1, 3.280839895).alias("side_m")))


@query("finite_counts", " SELECT cyl_id, CASE WHEN cyl_id % 3 = 0 THEN 0 WHEN cyl_id % 5 = 0 THEN 0 ELSE trunc(100 * length * (cyl_id % 7 - 3)) END::BIGINT AS whole FROM cylinders")
def _finite(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("cyl_id")
    v = F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 5 == 0, F.lit(float("inf"))).otherwise(F.col("length") * 100 * (k % 7 - 3))
    return lens.cylinders(spark, d).select("cyl_id", G.finite_or_zero(v).alias("whole"))


@query("half_even_digits", "SELECT p_partkey, round_even((p_partkey % 1000) / 8.0::DOUBLE, 2) AS rounded FROM part")
def _even(spark: SparkSession, d: str) -> DataFrame:
    return lens.table(spark, d, "part").select("p_partkey", G.half_even(F.col("p_partkey") % 1000 / 8.0, 2).alias("rounded"))


@query("time_suffixes", "SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400), '%Y%m%d_%H%M%S') AS suffix FROM orders")
def _suffix(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    return lens.table(spark, d, "orders").select("o_orderkey", G.time_suffix(t).alias("suffix"))


@query("enough_points", ", g AS (SELECT floor(x / 3) AS tx, floor(y / 3) AS ty, floor(z / 3) AS tz FROM points GROUP BY ALL HAVING count(*) >= 25) " + _stats_sql("points SEMI JOIN g ON floor(x / 3) = tx AND floor(y / 3) = ty AND floor(z / 3) = tz", "segment_label"))
def _enough(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d).withColumns({f"t{c}": F.floor(F.col(c) / 3) for c in "xyz"})
    return _stats(tiling.enough_points(p, ["tx", "ty", "tz"], 25), "segment_label")


@query("open_boxes", f"{_BOX}, o AS (SELECT bx.obs_id, bx.size FROM bx JOIN points p ON p.x > x0 AND p.x < x1 AND p.y > y0 AND p.y < y1 AND p.z > z0 AND p.z < z1) SELECT obs_id, size, count(*) AS n FROM o GROUP BY ALL")
def _open(spark: SparkSession, d: str) -> DataFrame:
    b = voxel.boxes(lens.observations(spark, d))
    j = spatial.box_join(b, lens.points(spark, d), 3.0, ["bx0", "by0", "bz0"], ["bx1", "by1", "bz1"], ["x", "y", "z"], closed=False)
    return j.groupBy("obs_id", "size").agg(F.count("*").alias("n"))


# --- joins, aggregates, sets ---------------------------------------------------------------


@query("positional_join", "WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier), b AS (SELECT s_name, row_number() OVER (ORDER BY s_name DESC) AS k FROM supplier) SELECT s_suppkey, s_name FROM a JOIN b USING (k)")
def _positional(spark: SparkSession, d: str) -> DataFrame:
    s = lens.table(spark, d, "supplier")
    return tiling.positional_join(s.select("s_suppkey"), s.select("s_name", (-F.col("s_suppkey")).alias("_k")), [F.col("s_suppkey")], [F.col("_k")]).select("s_suppkey", "s_name")


@query("tile_results", ", t AS (SELECT (floor(x / 5))::INTEGER AS tile, count(*) AS n_points FROM points GROUP BY 1), c AS (SELECT (floor(sx / 5))::INTEGER AS tile, count(*) AS n_cylinders FROM cylinders WHERE sx < 30 GROUP BY 1) SELECT tile, n_points, n_cylinders, n_cylinders IS NOT NULL AS has_results FROM t LEFT JOIN c USING (tile)")
def _results(spark: SparkSession, d: str) -> DataFrame:
    t = lens.points(spark, d).groupBy(F.floor(F.col("x") / 5).cast("int").alias("tile")).agg(F.count("*").alias("n_points"))
    c = lens.cylinders(spark, d).where("sx < 30").groupBy(F.floor(F.col("sx") / 5).cast("int").alias("tile")).agg(F.count("*").alias("n_cylinders"))
    return metrics.tile_results(t, c)


@query("largest_chords", " SELECT p.tree_id, round(max(sqrt((p.sx - q.sx) * (p.sx - q.sx) + (p.sy - q.sy) * (p.sy - q.sy))), 6) AS chord FROM cylinders p JOIN cylinders q USING (tree_id) GROUP BY 1")
def _chords(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    def chord(key, pdf):
        return pd.DataFrame({"tree_id": [key[0]], "chord": [largest_chord(pdf["sx"].to_numpy(), pdf["sy"].to_numpy())]})

    return r6(lens.cylinders(spark, d).select("tree_id", "sx", "sy").groupBy("tree_id").applyInPandas(chord, "tree_id long, chord double"))


@query("layer_centroids", " SELECT floor(z / 10)::BIGINT AS layer, cover_set, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, count(*) AS n FROM points GROUP BY ALL")
def _layer_means(spark: SparkSession, d: str) -> DataFrame:
    return r6(segment.layer_centroids(lens.points(spark, d).withColumn("layer", F.floor(F.col("z") / 10)), ["layer", "cover_set"]))


@query("status_counts", " SELECT count(*) AS n_points, count(*) FILTER (segment_label >= 0) AS n_labelled, count(DISTINCT segment_label) FILTER (segment_label >= 0) AS n_segments, (SELECT count(*) FROM cylinders) AS n_cylinders, (SELECT count(DISTINCT tree_id) FROM cylinders) AS n_trees FROM points")
def _status(spark: SparkSession, d: str) -> DataFrame:
    return metrics.status_counts(lens.points(spark, d), lens.cylinders(spark, d))


@query("empty_tiles", "SELECT 0::BIGINT AS n, NULL::DOUBLE AS sum_x")
def _empty_tiles(spark: SparkSession, d: str) -> DataFrame:
    p = lens.points(spark, d)
    return tiling.recombine([p.where("x < -1"), p.where("x > 1e9")], check=False).agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"))


@query("newest_runs", "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place FROM orders")
def _newest(spark: SparkSession, d: str) -> DataFrame:
    from arborlake.operators.ordered import running_totals

    o = runs.newest_first(lens.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")
    return running_totals(o, [-F.unix_date(F.col("o_orderdate").cast("date")), F.col("o_orderkey")], row_no="place").select("o_orderkey", "o_orderdate", "place")


# --- files written and read again ----------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "stage", f"query-{uuid.uuid4().hex}")


@query("cylinder_text", " SELECT count(*) AS n, round(sum(sx + 10), 6) AS sx, round(sum(sz), 6) AS sz, round(sum(length), 6) AS length, sum(branch_order)::BIGINT AS orders FROM cylinders")
def _cylinder_text(spark: SparkSession, d: str) -> DataFrame:
    """All cylinders as text in the world's frame, in two parts joined to one, read again."""
    c, path = lens.cylinders(spark, d), _folder(spark)
    at = [c.where("cyl_id % 2 = 0"), c.where("cyl_id % 2 = 1")]
    runs.combine_cylinders([x.withColumn("sx", F.col("sx") + 10) for x in at], path)
    return r6(runs.read_cylinders(spark, path).agg(F.count("*").alias("n"), F.sum("sx").alias("sx"), F.sum("sz").alias("sz"), F.sum("length").alias("length"), F.sum("branch_order").alias("orders")))


@query("tree_metrics_file", f"{_TREES} SELECT tree_id, n_cylinders, round(height_m, 6) AS height_m, round(total_volume_l, 6) AS total_volume_l, max_branch_order FROM trees")
def _metrics_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    runs.write_tree_metrics(metrics.tree_metrics(lens.cylinders(spark, d)), path)
    return r6(runs.read_tree_metrics(spark, path).select("tree_id", "n_cylinders", "height_m", "total_volume_l", "max_branch_order"))


@query("snapshot_fields", " SELECT segment_label, count(*) AS n, sum(line_no)::BIGINT AS line_no, round(sum(x), 6) AS sum_x, sum(order_key % 97)::BIGINT AS field_amplitude FROM points GROUP BY 1")
def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A run's points with fields besides, written and read again."""
    path = _folder(spark)
    p = lens.points(spark, d).withColumn("amplitude", (F.col("order_key") % 97).cast("int"))
    runs.Run(path, p, lens.cylinders(spark, d), (1.0, 2.0, 3.0), None).save(spark, "snapshot", {"patch": 0.1})
    back = runs.Run.open(spark, path)
    return r6(back.points.groupBy("segment_label").agg(F.count("*").alias("n"), F.sum("line_no").alias("line_no"), F.sum("x").alias("sum_x"), F.sum("amplitude").alias("field_amplitude")))


@query("run_metadata", "SELECT 'snapshot' AS run_name, (SELECT count(*) FROM lineitem) AS point_count, (SELECT count(*) FROM part) AS cylinder_count, true AS has_point_cloud, true AS has_segment_labels")
def _metadata(spark: SparkSession, d: str) -> DataFrame:
    root = _folder(spark)
    runs.Run(os.path.join(root, "a"), lens.points(spark, d), lens.cylinders(spark, d), (1.0, 2.0, 3.0), None).save(spark, "snapshot")
    return runs.find_runs(spark, root).select("run_name", "point_count", "cylinder_count", "has_point_cloud", "has_segment_labels")


@query("tile_tables", " SELECT (floor(x / 10))::INTEGER AS tile, count(*) AS n, round(sum(z), 6) AS sum_z FROM points GROUP BY ALL")
def _tile_tables(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    runs.write_tiles(lens.points(spark, d).withColumn("tile", F.floor(F.col("x") / 10).cast("int")), path)
    return _stats(spark.read.parquet(path), "tile", cols=("z",))


@query("xyz_text", " SELECT count(*) AS n, round(sum(x), 4) AS x, round(sum(z), 4) AS z, sum(segment_label)::BIGINT AS labels, -count(*) AS clusters FROM points")
def _xyz(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    exports.write_xyz(lens.points(spark, d), path, "labels")
    t = spark.read.option("sep", " ").schema("x double, y double, z double, intensity double, segment_label int, cluster_label int").csv(path)
    return t.agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("z"), 4).alias("z"), F.sum("segment_label").alias("labels"), F.sum("cluster_label").alias("clusters"))


@query("observation_file", "SELECT 'o' || s_suppkey AS observation_id, s_suppkey / 8.0::DOUBLE AS lon, (s_suppkey % 90)::DOUBLE AS lat, CASE WHEN s_suppkey % 4 = 0 THEN 2.0::DOUBLE ELSE (s_suppkey % 30)::DOUBLE END AS height_agl FROM supplier WHERE s_suppkey % 5 <> 0")
def _observation_file(spark: SparkSession, d: str) -> DataFrame:
    path, k = _folder(spark), F.col("s_suppkey")
    raw = lens.table(spark, d, "supplier").select(F.concat(F.lit("o"), k.cast("string")).alias("id"), F.when(k % 5 != 0, (k / 8.0).cast("string")).otherwise("n/a").alias("lon"), (k % 90).cast("string").alias("lat"), F.when(k % 4 != 0, (k % 30).cast("string")).alias("height_agl"))
    raw.write.option("header", True).csv(path)
    return runs.read_observations(spark, path)


# --- graphs over the vectors ----------------------------------------------------------------

_KNN = f"n AS (SELECT a.id AS ida, b.id AS idb, {_D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS rank FROM v a, v b WHERE a.id <> b.id)"


@query("gated_edges", f"WITH {_E}, {_KNN} SELECT DISTINCT least(ida, idb) AS src, greatest(ida, idb) AS dst, round(sqrt(d2), 6) AS w FROM n WHERE rank <= 4 AND sqrt(d2) <= 0.3::DOUBLE")
def _gated(spark: SparkSession, d: str) -> DataFrame:
    return r6(wood_paths.neighbour_graph(_vectors(spark, d), "id", 4, 0.25, 0.3))


_PREV = "prev AS (SELECT a.id AS n, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS step FROM v a JOIN v b ON b.id = a.id // 2 AND a.id > 0)"


@query("edge_cut", f"""WITH {_E}, ed AS (SELECT a.id AS src, b.id AS dst, sqrt({_D2}) AS w FROM v a, v b WHERE a.id < b.id AND {_D2} <= 0.4::DOUBLE * 0.4::DOUBLE), {_PREV}
SELECT src, dst, round(w, 6) AS w FROM ed LEFT JOIN prev p ON p.n = src LEFT JOIN prev q ON q.n = dst
WHERE NOT coalesce(w > 2 * CASE WHEN p.step IS NULL THEN q.step WHEN q.step IS NULL THEN p.step ELSE least(p.step, q.step) END, false)
  AND NOT coalesce(acos(least(greatest((p.dx * q.dx + p.dy * q.dy + p.dz * q.dz) / (p.step * q.step), -1.0), 1.0)) > pi() / 2, false)""")
def _cut(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the radius graph against steps from each vector to the one of half its id."""
    v = _vectors(spark, d)
    paths = v.select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.floor(F.col("id") / 2)).alias("prev"))
    return wood_paths.cut_radius_edges(v, 0.4, paths, "id").select("src", "dst", G.round6("w").alias("w"))


_DEMOTE = ", ".join(f"w{k + 1} AS (SELECT w.id, w.r FROM w{k} w LEFT JOIN w{k} u ON u.id = w.id // 2 AND w.id > 0 WHERE u.r IS NULL OR u.r <= 0 OR w.r <= u.r)" for k in range(3))


@query("demoted_wood", f"WITH w0 AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS r FROM embeddings), {_DEMOTE} SELECT id AS node, r AS radius FROM w3")
def _demoted(spark: SparkSession, d: str) -> DataFrame:
    w = lens.table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.round(F.col("embedding")[0].cast("double"), 6).alias("radius"))
    paths = w.select("node", F.when(F.col("node") > 0, F.floor(F.col("node") / 2)).alias("prev"))
    return wood_paths.demote_thick_children(w, paths)


@query("spaced_segments", f"""WITH {_E}, nn AS (SELECT a.id, min(sqrt({_D2})) AS d FROM v a, v b WHERE a.id <> b.id AND a.label = b.label AND {_D2} <= 1.0 GROUP BY 1)
SELECT label, count(*) AS n, round(avg(coalesce(d, 1.0)), 6) AS spacing FROM v LEFT JOIN nn USING (id) GROUP BY 1 HAVING count(*) >= 5 AND avg(coalesce(d, 1.0)) <= 0.25::DOUBLE""")
def _spaced(spark: SparkSession, d: str) -> DataFrame:
    return r6(wood_paths.spaced_segments(_vectors(spark, d), "label", "id", 0.25))


@query("big_components", f"""WITH RECURSIVE {_E}, vox AS (SELECT floor(x / 0.2)::INTEGER AS vx, floor(y / 0.2)::INTEGER AS vy, floor(z / 0.2)::INTEGER AS vz, count(*) AS n FROM v GROUP BY ALL),
num AS (SELECT *, row_number() OVER (ORDER BY vx, vy, vz) AS i FROM vox),
ed AS (SELECT a.i AS s, b.i AS t FROM num a, num b WHERE abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1),
re(i, c) AS (SELECT i, i FROM num UNION SELECT ed.t, re.c FROM re JOIN ed ON ed.s = re.i),
cc AS (SELECT i, min(c) AS c FROM re GROUP BY i), big AS (SELECT c FROM cc JOIN num USING (i) GROUP BY c HAVING sum(n) >= 6)
SELECT v.id FROM v JOIN num ON floor(x / 0.2) = vx AND floor(y / 0.2) = vy AND floor(z / 0.2) = vz JOIN cc USING (i) WHERE c IN (SELECT c FROM big)""")
def _big(spark: SparkSession, d: str) -> DataFrame:
    return graph.drop_small_components(_vectors(spark, d), 0.2, 6).select("id")


def _mst(edges: str) -> str:
    """Minimum spanning forest of ed0 (src, dst, w): an edge belongs to it if smaller edges do
    not join its ends already."""
    return f"""{edges}, ed1 AS (SELECT src, dst, w, row_number() OVER (ORDER BY w, src, dst) AS k FROM ed0),
both_ AS (SELECT src AS s, dst AS t, k FROM ed1 UNION ALL SELECT dst, src, k FROM ed1),
re(k, n) AS (SELECT k, src FROM ed1 UNION SELECT re.k, b.t FROM re JOIN both_ b ON b.s = re.n AND b.k < re.k),
mst AS (SELECT src, dst, w FROM ed1 e WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.k = e.k AND re.n = e.dst))"""


#: Oracles of queries that the main catalogue registers without one.
_PI = "3.141592653589793::DOUBLE"
_EIG = """, c AS (SELECT cover_set, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, count(*) AS n FROM points GROUP BY 1),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c),
p AS (SELECT *, greatest(sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6), 1e-300) AS p FROM q),
h AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / pow(p, 3) / 2 AS h FROM p),
f AS (SELECT *, acos(least(greatest(h, -1.0), 1.0)) / 3 AS phi FROM h),
l AS (SELECT *, q + 2 * p * cos(phi) AS l2, q + 2 * p * cos(phi + 2.0943951023931953::DOUBLE) AS l0 FROM f),
e AS (SELECT *, 3 * q - l2 - l0 AS l1 FROM l)"""
MORE_SQL = {
    "cylinder_basis": "SELECT p_partkey AS cyl_id, 0.0::DOUBLE AS ua, 0.0::DOUBLE AS va, 0.0::DOUBLE AS uv, 1.0::DOUBLE AS u_len FROM part",
    "surface_variation": f"{_EIG} SELECT cover_set, {', '.join(f'round({x}, 6) AS {x}' for x in ('xx', 'yy', 'zz', 'xy', 'xz', 'yz'))}, n, round(greatest(l0, 0.0) / (l0 + l1 + l2), 6) AS curvature, round((l2 - l1) / l2, 6) AS linearity FROM e",
    "principal_axes": f"""{_EIG}, v AS (SELECT cover_set, xy * yz - xz * (yy - l2) AS a, xz * xy - (xx - l2) * yz AS b, (xx - l2) * (yy - l2) - xy * xy AS g FROM e),
u AS (SELECT cover_set, a, b, g, sqrt(a * a + b * b + g * g) * CASE WHEN g < 0 THEN -1 ELSE 1 END AS s FROM v) SELECT cover_set, round(a / s, 6) AS ax, round(b / s, 6) AS ay, round(g / s, 6) AS az FROM u""",
    "component_shapes": f"""{_EIG}, m AS (SELECT cover_set, avg(x) AS mx, avg(y) AS my, count(*) AS k FROM points GROUP BY 1),
s AS (SELECT cover_set, any_value(mx) AS mx, any_value(my) AS my, any_value(k) AS k, sum(u * u) AS uu, sum(w * w) AS ww, sum(u * w) AS uw, sum(u * u * u + u * w * w) AS p3, sum(w * w * w + w * u * u) AS q3 FROM (SELECT cover_set, mx, my, k, x - mx AS u, y - my AS w FROM points JOIN m USING (cover_set)) GROUP BY 1),
ab AS (SELECT *, (p3 * ww - q3 * uw) / (uu * ww - uw * uw) / 2 AS a, (q3 * uu - p3 * uw) / (uu * ww - uw * uw) / 2 AS b FROM s),
ci AS (SELECT cover_set, a + mx AS cx, b + my AS cy, sqrt(a * a + b * b + (uu + ww) / k) AS r FROM ab),
er AS (SELECT cover_set, sqrt(avg(pow(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) - r, 2))) / any_value(r) AS relative_rmse FROM points JOIN ci USING (cover_set) GROUP BY 1),
ex AS (SELECT cover_set, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM points GROUP BY 1),
sh AS (SELECT cover_set, n, greatest(l0, 0.0) / (l0 + l1 + l2) AS curvature, (l2 - l1) / l2 AS linearity, r, relative_rmse, extent FROM e JOIN ci USING (cover_set) JOIN er USING (cover_set) JOIN ex USING (cover_set))
SELECT cover_set, n, round(curvature, 6) AS curvature, round(linearity, 6) AS linearity, round(r, 6) AS r, round(relative_rmse, 6) AS relative_rmse, round(extent, 6) AS extent,
  round(CASE WHEN relative_rmse < 0.25::DOUBLE AND curvature > 0.01::DOUBLE THEN r WHEN linearity > 0.9::DOUBLE THEN -linearity ELSE 0.0 END, 6)::DOUBLE AS radius FROM sh""",
    "spanning_forest": f"WITH RECURSIVE {_E}, " + _mst(f"ed0 AS (SELECT a.id AS src, b.id AS dst, round({_D2}, 9) AS w FROM v a, v b WHERE a.id < b.id AND {_D2} <= 0.4::DOUBLE * 0.4::DOUBLE)") + " SELECT * FROM mst",
    "skeleton_edges": f"WITH RECURSIVE {_E}, {_KNN}, " + _mst("ed0 AS (SELECT DISTINCT least(ida, idb) AS src, greatest(ida, idb) AS dst, sqrt(d2) AS w FROM n WHERE rank <= 6)")
    + ", deg AS (SELECT n FROM (SELECT src AS n FROM mst UNION ALL SELECT dst FROM mst) GROUP BY n HAVING count(*) > 3) SELECT src, dst, round(w, 6) AS w FROM mst WHERE src NOT IN (SELECT n FROM deg) AND dst NOT IN (SELECT n FROM deg)",
    "cover_sets": f"""WITH {_E}, s0 AS (SELECT arg_min(id, (md5(id::VARCHAR), id)) AS seed FROM v GROUP BY floor(x / 0.4::DOUBLE), floor(y / 0.4::DOUBLE), floor(z / 0.4::DOUBLE)), s AS (SELECT v.* FROM v JOIN s0 ON id = seed),
o AS (SELECT a.id, arg_min(b.id, ({_D2}, b.id)) AS seed FROM v a JOIN s b ON {_D2} <= 0.5::DOUBLE * 0.5::DOUBLE GROUP BY a.id), big AS (SELECT seed FROM o GROUP BY seed HAVING count(*) >= 2)
SELECT v.id, v.x, v.y, v.z, coalesce(big.seed, -1) AS cover_set FROM v LEFT JOIN o USING (id) LEFT JOIN big USING (seed)""",
    "cloth_ground": ", lo AS (SELECT floor(x / 2)::INTEGER AS ix, floor(y / 2)::INTEGER AS iy, min(z) AS low FROM points GROUP BY ALL), c0 AS (SELECT *, low AS c FROM lo), "
    + ", ".join(f"c{k + 1} AS (SELECT a.ix, a.iy, any_value(a.low) AS low, least(any_value(a.low), avg(b.c)) AS c FROM c{k} a JOIN c{k} b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 GROUP BY a.ix, a.iy)" for k in range(5))
    + " SELECT abs(z - c) < 0.5::DOUBLE AS is_ground, count(*) AS n FROM points JOIN c5 ON floor(x / 2)::INTEGER = ix AND floor(y / 2)::INTEGER = iy GROUP BY ALL",
    "random_cap": " SELECT * FROM points ORDER BY md5(concat_ws(':', 'sample', order_key, line_no, round_even(x * 100, 0)::BIGINT, round_even(y * 1e6, 0)::BIGINT, round_even(z * 50, 0)::BIGINT)), order_key, line_no LIMIT 200",
    "model_criteria": f""", m AS (SELECT *, tree_id % 8 AS model_id, radius / 10 AS mad, (cyl_id % 12) / 12.0::DOUBLE AS surf_cov, floor(degrees(acos(least(abs(az), 1.0))) / 10)::INTEGER AS z FROM cylinders),
a AS (SELECT model_id, {', '.join(f'{metrics.CRITERIA[n]} AS "{n}"' for n in metrics._BY_CYLINDER)} FROM m GROUP BY 1),
o0 AS (SELECT model_id, branch_order AS o, sum(pi() * radius * radius * length) AS vol, sum(2 * pi() * radius * length) AS are, sum(length) AS len, count(*) AS num FROM m GROUP BY ALL),
b AS (SELECT model_id, {', '.join(f'{metrics.CRITERIA[n]} AS "{n}"' for n in metrics._BY_ORDER)} FROM o0 GROUP BY 1),
z0 AS (SELECT model_id, z, sum(pi() * radius * radius * length) AS vol, sum(2 * pi() * radius * length) AS are, sum(length) AS len FROM m GROUP BY ALL),
g AS (SELECT model_id, {', '.join(f'{metrics.CRITERIA[n]} AS "{n}"' for n in metrics._BY_ZENITH)} FROM z0 GROUP BY 1)
SELECT model_id, unnest([{', '.join(f"'{n}'" for n in metrics.CRITERIA)}]) AS criterion, unnest([{', '.join(f'round("{n}", 6)' for n in metrics.CRITERIA)}]) AS value FROM a JOIN b USING (model_id) JOIN g USING (model_id)""",
}
