"""Running totals over a global order, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.session import cut_lineage


def running_total(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the group that come before.

    Rows are range-partitioned by group and order and written once, so a hot group
    spreads over partitions; only partition totals are summed across them.
    """
    ranged = cut_lineage(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    group = by or [F.lit(1)]
    totals = (
        ranged.groupBy(*by, "_p").agg(F.sum(value).alias("_m"))
        .withColumn("_below", F.coalesce(F.sum("_m").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(*(F.col(c).alias(f"_t{i}") for i, c in enumerate(by)), F.col("_p").alias("_q"), "_below")
    )
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_t{i}"))
    inside = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, same)
        .withColumn(out, F.col("_below") + F.col("_in")).drop("_p", "_q", "_in", "_below", *(f"_t{i}" for i in range(len(by))))
    )
