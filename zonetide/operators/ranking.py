"""Ranks, exact quantiles, top-k and set operations that survive skew.

Ranks and quantiles over many rows go through :func:`cumulative_counts`: equal
values are collapsed by a partial aggregation, the distinct values are
range-partitioned, and only partition totals are summed across tasks.  No task
ever sorts a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.session import cut_lineage


def _ranged(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Rows in range partitions with the partition number as ``_p``.

    The table is written once: partition numbers carry offsets and must not
    change when a task is repeated, and every later step reads this table
    instead of the source.
    """
    return cut_lineage(df.repartitionByRange(*columns).withColumn("_p", F.spark_partition_id()), name)


def cumulative_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, _n, _before, _total): rows below each distinct value.

    ``_before`` counts rows of the group with a smaller value, ``_total`` all
    rows of the group.  Null values are left out.
    """
    by = list(by)
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = _ranged(distinct, [*by, "_v"], "counts")
    # one row per partition and group
    group = by or [F.lit(1)]
    across = Window.partitionBy(*group).orderBy("_p")
    totals = (
        ranged.groupBy(*by, "_p").agg(F.sum("_n").alias("_m"))
        .withColumn("_below", F.coalesce(F.sum("_m").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_total", F.sum("_m").over(Window.partitionBy(*group)))
        .drop("_m")
    )
    inside = Window.partitionBy(*by, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(totals, by + ["_p"])
        .select(*by, F.col("_v").alias(value), "_n", (F.col("_below") + F.col("_in")).alias("_before"), "_total")
    )


def average_rank(
    df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank", percent: bool = False, bounded: bool = False
) -> DataFrame:
    """Rank from 1 with ties averaged, or that rank over the group size.

    ``df`` is read twice, so write it first where it is costly to derive.
    ``bounded`` says that a group is as long as a calendar at most; it is then
    ranked by plain windows on one shuffle.
    """
    if bounded:
        group = Window.partitionBy(*by)
        ties = F.count(value).over(Window.partitionBy(*by, value))
        rank = F.rank().over(group.orderBy(F.col(value).asc_nulls_last())) + (ties - 1) / 2
        rank = rank / F.count(value).over(group) if percent else rank
        return df.withColumn(out, F.when(F.col(value).isNotNull(), rank))
    ranks = cumulative_counts(df, value, by)
    rank = F.col("_before") + (F.col("_n") + 1) / 2
    ranks = ranks.select(*by, value, (rank / F.col("_total") if percent else rank).alias(out))
    return df.join(ranks, list(by) + [value], "left")


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    ranked = cumulative_counts(df, value, by)
    v = F.col(value).cast("double")
    outs = []
    for name, p in probs.items():
        spot = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)

        def at(i: Column) -> Column:
            return F.max(F.when((F.col("_before") <= i) & (i < F.col("_before") + F.col("_n")), v))

        outs += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}"), F.max(spot - low).alias(f"_w_{name}")]
    rows = ranked.groupBy(*by).agg(*outs)
    return rows.select(
        *by,
        *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in probs],
    )


def one_row(df: DataFrame) -> dict[str, Column]:
    """The columns of a one-row frame as fields of a single scalar subquery.

    Several ``scalar()`` calls on one frame would plan it several times.
    """
    packed = df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()
    return {c: packed[c] for c in df.columns}


def column_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, Column]:
    """Exact quantiles of several columns as scalars, from one pass.

    ``wanted`` maps a name to its column and probability.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    name = {p: f"q{i}" for i, p in enumerate(sorted({p for _, p in wanted.values()}))}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "_c", "_x")
    rows = quantiles(long, "_x", {q: p for p, q in name.items()}, ["_c"])
    return one_row(rows.agg(*[F.max(F.when(F.col("_c") == c, F.col(name[p]))).alias(n) for n, (c, p) in wanted.items()]))


def scalar_quantile(df: DataFrame, value: str, p: float) -> Column:
    """An exact quantile of a whole column as a scalar subquery."""
    return quantiles(df, value, {"q": p}).scalar()


def dense_ids(df: DataFrame, name: str, out: str = "id") -> DataFrame:
    """0..N-1 by sorted name over the distinct names, in parallel."""
    ranged = _ranged(df.select(name).filter(F.col(name).isNotNull()).distinct(), [name], "ids")
    across = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_m")).select("_p", F.coalesce(F.sum("_m").over(across), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_p").orderBy(name)
    return (
        ranged.withColumn("_r", F.row_number().over(inside)).join(offsets, "_p")
        .select(name, (F.col("_o") + F.col("_r") - 1).cast("bigint").alias(out))
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k; Spark keeps k rows per task before the merge."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "pos") -> DataFrame:
    """Top-k of every group.

    The filter on ``row_number`` lets Spark drop rows beyond k in each map task
    (window group limit) before the shuffle, so a hot group arrives small.
    """
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= k)


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return top_k_per_group(df, by, order, 1, "_pos").drop("_pos")


def both_ends(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The k highest and the k lowest rows, tagged."""
    high = top_k(df, [F.col(value).desc(), F.col(tie)], k).withColumn("side", F.lit("high"))
    low = top_k(df, [F.col(value).asc(), F.col(tie)], k).withColumn("side", F.lit("low"))
    return high.unionByName(low)


def by_custom_order(df: DataFrame, column: str, order: Sequence[str], *then: Column) -> DataFrame:
    """Sort by the position of a value in a list, unknown values last."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return df.withColumn("place", F.when(place == 0, len(order) + 1).otherwise(place)).orderBy("place", *then)


def compare_lists(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Which keys entered, left or stayed between two lists."""
    left = a.select(key, F.lit(True).alias("_a"))
    right = b.select(key, F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "entered").otherwise("kept")
    return left.join(right, key, "full_outer").select(key, status.alias("status"))
