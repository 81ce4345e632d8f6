"""Figures of a run, of trees and of classifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions.geometry import DIAMETER_CLASSES, RADIUS_CLASSES, bin_index, cylinder_volume, diameter_class, norm, radius_class, slenderness, zenith
from arborlake.operators.ordered import running_totals

OUTLIER = 100.0
BREAST_HEIGHT = 1.3


def run_summary(cyl: DataFrame) -> DataFrame:
    """One row: counts, diameters, lengths and volumes of all cylinders; a cylinder more than
    100 diameters long is an outlier."""
    v = cylinder_volume("radius", "length")
    out = slenderness("radius", "length") > OUTLIER
    return cyl.agg(
        F.count("*").alias("n_cylinders"),
        F.avg(F.col("radius") * 200).alias("mean_diameter_cm"),
        F.median(F.col("radius") * 200).alias("median_diameter_cm"),
        F.avg("length").alias("mean_length_m"),
        (F.coalesce(F.sum(v), F.lit(0.0)) * 1000).alias("total_volume_l"),
        F.median(v * 1e6).alias("median_volume_ml"),
        F.count_if(out).alias("n_outliers"),
        (F.coalesce(F.sum(F.when(~out, v)), F.lit(0.0)) * 1000).alias("volume_without_outliers_l"),
    )


def histogram(df: DataFrame, value: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """bin, lower, upper, n of equal bins over the data's range or [lo, hi]; the last is
    closed; empty bins are listed; values outside [lo, hi] and nulls are not counted."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    if lo is None or hi is None:
        span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null")
    else:
        span = v.sparkSession.createDataFrame([(float(lo), float(hi))], "lo double, hi double")
    span = F.broadcast(span)  # one row
    inside = v.crossJoin(span).where("v between lo and hi")
    counted = inside.groupBy(bin_index("v", "lo", "hi", F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    w = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * w).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * w).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dbh_bins(n: int) -> int:
    return min(20, max(5, n))


def _listed(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    every = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "class_no int, class_name string")
    return every.join(df, every["class_no"] == df[key], "left")


def diameter_classes(cyl: DataFrame) -> DataFrame:
    """Count and length of the five diameter classes, empty ones included."""
    c = cyl.groupBy(diameter_class("radius").alias("k")).agg(F.count("*").alias("n"), F.sum("length").alias("len"))
    return _listed(c, "k", DIAMETER_CLASSES).select("class_no", "class_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("len", F.lit(0.0)).alias("total_length"))


def radius_classes(cyl: DataFrame) -> DataFrame:
    c = cyl.groupBy(radius_class("radius").alias("k")).agg(F.count("*").alias("n"), F.sum("length").alias("len"))
    every = cyl.sparkSession.createDataFrame([(n,) for n in RADIUS_CLASSES], "class_name string")
    return every.join(c, every["class_name"] == c["k"], "left").select("class_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("len", F.lit(0.0)).alias("total_length"))


def branch_orders(cyl: DataFrame) -> DataFrame:
    """Cylinders of each branch order from 0 to the largest."""
    c = cyl.where("branch_order is not null").groupBy("branch_order").agg(F.count("*").alias("n"))
    top = c.agg(F.max("branch_order").alias("top")).where("top is not null")
    every = top.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("branch_order"))
    return every.join(c, "branch_order", "left").select("branch_order", F.coalesce("n", F.lit(0)).alias("n"))


def trunk_split(cyl: DataFrame) -> DataFrame:
    """Trunk and branch figures: the trunk has the least branch order of the run, or, without
    orders, leans less than 30 degrees from the vertical."""
    least = F.broadcast(cyl.agg(F.min("branch_order").alias("least")))  # one row
    trunk = F.when(F.col("least").isNotNull(), F.coalesce(F.col("branch_order") == F.col("least"), F.lit(False))).otherwise(zenith("az") < 30)
    c = cyl.crossJoin(least).withColumn("part", F.when(trunk, "trunk").otherwise("branch"))
    return c.groupBy("part").agg(F.count("*").alias("n"), (F.sum(cylinder_volume("radius", "length")) * 1000).alias("volume_l"), F.sum("length").alias("total_length"))


def slender_outliers(cyl: DataFrame, most: float = OUTLIER) -> DataFrame:
    return cyl.select("cyl_id", slenderness("radius", "length").alias("slenderness")).where(F.col("slenderness") > most)


def tree_metrics(cyl: DataFrame) -> DataFrame:
    """One row for each tree: cylinders, height (range of ends), diameter at breast height
    (null below 1.3 m), basal diameter (of the lowest trunk cylinder), volumes, orders."""
    from arborlake.functions.geometry import cylinder_end

    v = cylinder_volume("radius", "length") * 1000
    end_z = cylinder_end(["sx", "sy", "sz"], ["ax", "ay", "az"], "length")[2]
    c = cyl.withColumn("end_z", end_z).withColumn("v", v)
    w = Window.partitionBy("tree_id")
    c = c.withColumn("floor_z", F.min(F.least("sz", "end_z")).over(w)).withColumn("base_order", F.min("branch_order").over(w))
    trunk = F.coalesce(F.col("branch_order") == F.col("base_order"), F.lit(True))
    off = F.abs((F.col("sz") + F.col("end_z")) / 2 - F.col("floor_z") - BREAST_HEIGHT)
    m = c.groupBy("tree_id").agg(
        F.count("*").alias("n_cylinders"),
        (F.max(F.greatest("sz", "end_z")) - F.min("floor_z")).alias("height_m"),
        F.min_by(F.when(trunk, F.col("radius") * 200), F.when(trunk, F.struct(off, F.col("cyl_id")))).alias("dbh"),
        F.min_by(F.when(trunk, F.col("radius") * 200), F.when(trunk, F.struct(F.col("sz"), F.col("cyl_id")))).alias("basal_diam_cm"),
        F.sum("v").alias("total_volume_l"),
        F.sum(F.when(trunk, F.col("v")).otherwise(0.0)).alias("trunk_volume_l"),
        F.sum(F.when(~trunk, F.col("v")).otherwise(0.0)).alias("branch_volume_l"),
        F.max("branch_order").alias("max_branch_order"),
        F.count_distinct(F.when(~trunk, F.col("branch_order"))).alias("n_branch_orders"),
    )
    return m.withColumn("dbh_cm", F.when(F.col("height_m") >= BREAST_HEIGHT, F.col("dbh"))).drop("dbh")


def tree_summary(trees: DataFrame) -> DataFrame:
    return trees.agg(F.count("*").alias("n_trees"), F.median("height_m").alias("median_height_m"), F.median("dbh_cm").alias("median_dbh_cm"), F.coalesce(F.sum("total_volume_l"), F.lit(0.0)).alias("total_volume_l"))


def click_volume(clicks: DataFrame, cyl: DataFrame, r: float = 0.5) -> DataFrame:
    """clicks (click_id, cx, cy, cz): count and volume of the cylinders of which an end lies
    strictly nearer than r."""
    from arborlake.functions.geometry import cylinder_end
    from arborlake.operators.spatial import radius_pairs

    ends = cylinder_end(["sx", "sy", "sz"], ["ax", "ay", "az"], "length")
    v = cylinder_volume("radius", "length")
    tips = cyl.select("cyl_id", v.alias("v"), F.explode(F.array(F.struct(*[F.col(s).alias(n) for s, n in zip(["sx", "sy", "sz"], "xyz")]), F.struct(*[e.alias(n) for e, n in zip(ends, "xyz")]))).alias("t"))
    tips = tips.select("cyl_id", "v", F.col("t.x").alias("tx"), F.col("t.y").alias("ty"), F.col("t.z").alias("tz"))
    hit = radius_pairs(clicks, tips, r, ["cx", "cy", "cz"], ["tx", "ty", "tz"]).where(F.sqrt("d2") < r)
    hit = hit.groupBy("click_id", "cyl_id").agg(F.first("v").alias("v"))
    got = hit.groupBy("click_id").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    return clicks.select("click_id").join(got, "click_id", "left").select("click_id", F.coalesce("n", F.lit(0)).alias("n_cylinders"), F.coalesce("v", F.lit(0.0)).alias("volume_m3"))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Two classes, 1 positive: counts, precision, recall and F1 of both, accuracy, kappa."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    rate = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    acc = F.try_divide(F.col("tp") + F.col("tn"), n)
    chance = F.try_divide((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("tn") + F.col("fn")) * (F.col("tn") + F.col("fp")), n.cast("double") * n)
    f1 = lambda a, b, d: F.try_divide(2.0 * F.col(a), 2 * F.col(a) + F.col(b) + F.col(d))
    return c.select(
        "tp", "fp", "fn", "tn", rate("tp", "fp").alias("precision_pos"), rate("tp", "fn").alias("recall_pos"), f1("tp", "fp", "fn").alias("f1_pos"),
        rate("tn", "fn").alias("precision_neg"), rate("tn", "fp").alias("recall_neg"), f1("tn", "fn", "fp").alias("f1_neg"), acc.alias("accuracy"), F.try_divide(acc - chance, 1 - chance).alias("kappa"),
    )


def thickness_split(cyl: DataFrame, most: float = 0.1) -> DataFrame:
    """Column thick: radius above ``most``.  Cylinders whose axis has no direction are left out."""
    return cyl.where(norm("ax", "ay", "az") > 1e-9).withColumn("thick", F.col("radius") > most)


def without_wide(cyl: DataFrame, limit: float = 0.15) -> DataFrame:
    """Fitted cylinders thinner than ``limit`` (radius in metres); wider ones are bad fits."""
    return cyl.where(F.col("radius") < limit)


def status_counts(pts: DataFrame, cyl: DataFrame) -> DataFrame:
    """One row: points, labelled points, segments, cylinders and trees of a run."""
    p = pts.agg(F.count("*").alias("n_points"), F.count_if(F.col("segment_label") >= 0).alias("n_labelled"), F.count_distinct(F.when(F.col("segment_label") >= 0, F.col("segment_label"))).alias("n_segments"))
    c = cyl.agg(F.count("*").alias("n_cylinders"), F.count_distinct("tree_id").alias("n_trees"))
    return p.crossJoin(F.broadcast(c))  # one row each


def tile_results(tiles: DataFrame, results: DataFrame, tile: str = "tile") -> DataFrame:
    """Every tile with what its results say, and whether it has any."""
    has = results.withColumn("has_results", F.lit(True))
    return tiles.join(has, tile, "left").withColumn("has_results", F.coalesce("has_results", F.lit(False)))


def _criteria() -> dict[str, str]:
    """The 91 criteria by name, as SQL over one model's figures.

    A part's figure is an aggregate over its cylinders; a name that joins parts by + is the
    sum of theirs.  Coverage is taken as 1 - coverage, so that smaller is always better."""
    part = {"all": "true", "trunk": "branch_order = 0", "branch": "branch_order > 0", "1branch": "branch_order = 1", "2branch": "branch_order = 2"}
    joined = [*part, "trunk+branch", "trunk+1branch", "trunk+1branch+2branch", "1branch+2branch"]
    size = {"vol": "pi() * radius * radius * length", "are": "2 * pi() * radius * length", "len": "length"}
    over = lambda f, name: "(" + " + ".join(f.format(part[x]) for x in name.split("+")) + ")"
    mean, most = "avg(mad) FILTER (WHERE {0})", "max(mad) FILTER (WHERE {0})"
    out = {f"{n}_mean_dis": over(mean, n) for n in joined}
    out |= {f"{n}_max_dis": over(most, n) for n in joined}
    out |= {f"{n}_mean+max_dis": f"({over(mean, n)} + {over(most, n)})" for n in joined}
    for k, e in size.items():
        f = f"stddev_samp({e}) FILTER (WHERE {{0}})"
        out |= {f"{n}_{k}_std": over(f, "all" if n == "tot" else n) for n in (["tot"] if k != "len" else []) + ["trunk", "branch", "trunk+branch"]}
    out["branch_num_std"] = "stddev_samp(num) FILTER (WHERE o > 0)"
    for o in (3, 6):
        for g in ("mean", "max"):
            out |= {f"branch_{k}_ord{o}_{g}": f"{'avg' if g == 'mean' else 'max'}({k}) FILTER (WHERE o BETWEEN 1 AND {o})" for k in ("vol", "are", "len", "num")}
    for d in (10, 20):
        for g in ("mean", "max"):
            out |= {f"cyl_{k}_dia{d}_{g}": f"{'avg' if g == 'mean' else 'max'}({e}) FILTER (WHERE radius * 200 <= {d})" for k, e in size.items()}
    for g in ("mean", "max"):
        out |= {f"cyl_{k}_zen_{g}": f"{'avg' if g == 'mean' else 'max'}({k}) FILTER (WHERE z >= 0)" for k in size}
    for g in ("mean", "min"):
        f = f"(1 - {'avg' if g == 'mean' else 'min'}(surf_cov) FILTER (WHERE {{0}}))"
        out |= {f"{n}_{g}_surf": over(f, n) for n in joined}
    return out


CRITERIA = _criteria()
_BY_ORDER = [n for n in CRITERIA if "_ord" in n or n == "branch_num_std"]
_BY_ZENITH = [n for n in CRITERIA if "_zen_" in n]
_BY_CYLINDER = [n for n in CRITERIA if n not in _BY_ORDER and n not in _BY_ZENITH]


def model_criteria(cyl: DataFrame, model: str = "model_id") -> DataFrame:
    """Long table (model, criterion, value) of the 91 criteria for choosing among several
    models of one tree: distances to the surface (column mad), surface coverage (surf_cov),
    spread of volumes, areas and lengths, totals by branch order, cylinders by diameter, and
    totals by ten-degree classes of the zenith.  A criterion over nothing is null."""
    totals = [F.sum(cylinder_volume("radius", "length")).alias("vol"), F.sum(F.expr("2 * pi() * radius * length")).alias("are"), F.sum("length").alias("len"), F.count("*").alias("num")]
    pick = lambda names: [F.expr(CRITERIA[n]).alias(n) for n in names]
    wide = cyl.groupBy(model).agg(*pick(_BY_CYLINDER))
    orders = cyl.groupBy(model, F.col("branch_order").alias("o")).agg(*totals).groupBy(model).agg(*pick(_BY_ORDER))
    zenith_class = F.floor(zenith("az") / 10).cast("int")
    zeniths = cyl.groupBy(model, zenith_class.alias("z")).agg(*totals).groupBy(model).agg(*pick(_BY_ZENITH))
    wide = wide.join(orders, model).join(zeniths, model)
    return wide.unpivot([model], [F.col(f"`{n}`") for n in CRITERIA], "criterion", "value")


def best_models(criteria: DataFrame, model: str = "model_id") -> DataFrame:
    """The model with the least value of each criterion, ties to the smaller id."""
    return criteria.where("value is not null").groupBy("criterion").agg(F.min_by(model, F.struct("value", model)).alias(model), F.min("value").alias("value"))


def color_rank(df: DataFrame, key: str) -> DataFrame:
    """Each distinct id with its rank moved into (0, 1)."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    n = F.broadcast(ids.agg(F.count("*").alias("n")))  # one row
    return running_totals(ids, [F.col(key)]).crossJoin(n).select(key, ((F.col("row_no") + F.lit(0.5)) / F.col("n")).alias("shade"))


def extent(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[f(c).alias(f"{c}{i}") for i, f in ((0, F.min), (1, F.max)) for c in "xyz"], F.count("*").alias("n_points"))


def axis_length(cyl: DataFrame) -> DataFrame:
    return cyl.select("cyl_id", norm("ax", "ay", "az").alias("axis_norm"))
