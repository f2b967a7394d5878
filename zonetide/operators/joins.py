"""Lookups, priority assignment, period offsets and as-of joins.

No join carries a broadcast hint: Spark broadcasts a side when its measured size
is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise, and
adaptive execution splits the partitions of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.operators.ranking import keep_first


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join on a key with a default for missing values."""
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def two_tier_lookup(df: DataFrame, dim: DataFrame, outer: str, inner: str, value: str, priority: str) -> DataFrame:
    """Prefer a match on (outer, inner), fall back to inner alone.

    Several sources may list the same key; the lowest priority number wins.
    """
    exact = keep_first(dim, [outer, inner], [F.col(priority), F.col(value)]).select(outer, inner, F.col(value).alias("_exact"))
    loose = keep_first(dim, [inner], [F.col(priority), F.col(outer), F.col(value)]).select(inner, F.col(value).alias("_loose"))
    return (
        df.join(exact, [outer, inner], "left").join(loose, inner, "left")
        .withColumn(value, F.coalesce("_exact", "_loose"))
        .withColumn("tier", F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "loose").otherwise("none"))
        .drop("_exact", "_loose")
    )


def blank_fallback_counts(left: DataFrame, right: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Sum of ``value`` matched on (outer, inner); on inner where outer is blank."""
    blank = F.coalesce(F.trim(F.col(outer).cast("string")), F.lit("")) == ""
    pair_sums = right.groupBy(outer, inner).agg(F.sum(value).alias(value))
    inner_sums = right.groupBy(inner).agg(F.sum(value).alias(value))
    full = left.filter(~blank).join(pair_sums, [outer, inner], "left")
    loose = left.filter(blank).join(inner_sums, inner, "left")
    return full.unionByName(loose).na.fill(0, subset=[value])


def cascade(candidates: DataFrame, key: str, layer: str, order: Sequence[str], *ties: Column) -> DataFrame:
    """Assign each key to its first layer in the given order, in one pass."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(layer))
    return keep_first(candidates.filter(place > 0), [key], [place, *ties])


def month_number(col: Column | str) -> Column:
    """Months since year 0, so that calendar months are one apart."""
    return F.year(col) * 12 + F.month(col)


def period_neighbours(series: DataFrame, zone: str, month: str, value: str, offsets: Sequence[int]) -> DataFrame:
    """Values at other months, by calendar arithmetic (months may be missing).

    A frame of exactly one month at each distance replaces a self-join.
    """
    w = Window.partitionBy(zone).orderBy(month_number(month))
    names = {k: f"{value}_{'prev' if k < 0 else 'next'}{abs(k) if abs(k) > 1 else ''}" for k in offsets}
    return series.withColumns({n: F.max(value).over(w.rangeBetween(k, k)) for k, n in names.items()})


def as_of(panel: DataFrame, snapshots: DataFrame, zone: str, date: str, value: str, exact: bool = False) -> DataFrame:
    """The last snapshot on or before each row's date.

    Both sides are merged and carried forward in one window per zone, instead of
    a range join.
    """
    if exact:
        return panel.join(snapshots.select(zone, date, value), [zone, date], "left")
    # equal dates: snapshot first
    marks = snapshots.select(zone, date, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    rows = panel.withColumn("_side", F.lit(1))
    frame = Window.partitionBy(zone).orderBy(date, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.unionByName(marks, allowMissingColumns=True)
        .withColumn(value, F.last("_v", ignorenulls=True).over(frame))
        .filter(F.col("_side") == 1).drop("_side", "_v")
    )


def pairs_within_score(df: DataFrame, key: str, score: str, reach: float) -> DataFrame:
    """Pairs a < b whose scores differ by less than ``reach``.

    Scores are cut into bands one reach wide, so partners lie in the same or the
    next band; only candidates of two bands meet.
    """
    band = F.floor(F.col(score) / F.lit(reach))
    left = df.select(F.col(key).alias("a"), F.col(score).alias("sa"), F.explode(F.sequence(band - 1, band + 1)).alias("_band"))
    right = df.select(F.col(key).alias("b"), F.col(score).alias("sb"), band.alias("_band"))
    return left.join(right, "_band").filter((F.col("a") < F.col("b")) & (F.abs(F.col("sa") - F.col("sb")) < reach)).drop("_band")


def flag_match(df: DataFrame, dim: DataFrame, key: str, out: str) -> DataFrame:
    """1 where the key is listed (a holiday table, say), else 0."""
    listed = dim.select(key).distinct().withColumn(out, F.lit(1))
    return df.join(listed, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def merge_by_id(base: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """New value by id where given, the old one otherwise."""
    fresh = updates.select(key, F.col(column).alias("_new"))
    return base.join(fresh, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
