"""Global order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.plans.stage import materialise


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, row_no: str = "row_no") -> DataFrame:
    """df with the number of rows before each one and, for each of ``sums``, the total of its
    expression over those rows.  ``order`` should tell all rows apart.

    Rows are dealt to partitions by ranges of the order; each partition's totals (one row a
    partition) give what lies before it, and a window counts inside it."""
    sums = sums or {}
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)} | {f"_s{i}": c for i, c in enumerate(sums.values())})
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    keyed = materialise(keyed.repartitionByRange(*[k.asc_nulls_last() for k in keys]).withColumn("_pid", F.spark_partition_id()), "ordered")
    totals = keyed.groupBy("_pid").agg(F.count("*").alias("n"), *[F.sum(f"_s{i}").alias(f"t{i}") for i in range(len(sums))]).orderBy("_pid").collect()
    before, rows = [0] * (1 + len(sums)), []
    for t in totals:
        rows.append((t["_pid"], *before))
        before = [b + (x or 0) for b, x in zip(before, list(t)[1:])]
    kinds = ["long", *[keyed.schema[f"_s{i}"].dataType.simpleString().replace("int", "bigint").replace("bigbigint", "bigint") for i in range(len(sums))]]
    schema = "_p int, " + ", ".join(f"_b{i} {k}" for i, k in enumerate(kinds))
    start = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # one row a partition
    w = Window.partitionBy("_pid").orderBy(*[k.asc_nulls_last() for k in keys])
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(start, keyed["_pid"] == start["_p"]).withColumn(row_no, F.col("_b0") + F.row_number().over(w) - 1)
    for i, name in enumerate(sums):
        out = out.withColumn(name, F.col(f"_b{i + 1}") + F.coalesce(F.sum(f"_s{i}").over(prior), F.lit(0)))
    return out.drop("_pid", "_p", *[f"_o{i}" for i in range(len(order))], *[f"_s{i}" for i in range(len(sums))], *[f"_b{i}" for i in range(len(sums) + 1)])
