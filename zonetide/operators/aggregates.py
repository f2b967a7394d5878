"""Counts, shares, profiles and concentration measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.functions.numbers import ratio
from zonetide.functions.stats import stability
from zonetide.operators.ranking import keep_first


def counted(weight: str | None) -> Column:
    """Number of rows, or of the events that pre-counted rows stand for."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def month_rollup(events: DataFrame, month: str, zone: str, weight: str | None = None) -> DataFrame:
    """Counts per (month, zone) and per month, from one scan."""
    return (
        events.rollup(month, zone)
        .agg(counted(weight).alias("n"), F.grouping(zone).cast("int").alias("is_total"), F.grouping(month).alias("_all"))
        .filter("_all = 0").drop("_all")
    )


def season_counts(events: DataFrame, key: Sequence[str], parts: dict[str, Sequence[str]]) -> DataFrame:
    """Counts by key and each named set of time parts, in one scan.

    ``parts`` maps a set name to its columns; unused columns are null.  Events are
    counted by all parts first, so the sets multiply counts, not events.
    """
    columns = list(dict.fromkeys(c for cols in parts.values() for c in cols))
    sets = [[F.col(c) for c in [*key, *cols]] for cols in parts.values()]
    cells = events.groupBy(*key, *columns).agg(F.count(F.lit(1)).alias("_n"))
    grouped = cells.groupingSets(sets, *[F.col(c) for c in [*key, *columns]]).agg(
        F.sum("_n").alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in columns]
    )
    label = None
    for name, cols in parts.items():
        test = F.lit(True)
        for c in columns:
            test = test & (F.col(f"_g_{c}") == (0 if c in cols else 1))
        label = F.when(test, name) if label is None else label.when(test, name)
    return grouped.withColumn("part", label).drop(*[f"_g_{c}" for c in columns])


def share_within(df: DataFrame, by: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """value / total of its group, through a pre-aggregated total."""
    if not by:
        total = df.select(F.sum(value)).scalar()
        return df.withColumn(out, ratio(F.col(value), total))
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    return df.join(totals, list(by)).withColumn(out, ratio(F.col(value), F.col("_total"))).drop("_total")


def seasonal_index(events: DataFrame, key: Sequence[str], part: str, weight: str | None = None) -> DataFrame:
    """Count per part over the mean count of the parts present, and its share.

    The windows run over a few parts per key, after the counting.
    """
    counts = events.groupBy(*key, part).agg(counted(weight).alias("n"))
    group = Window.partitionBy(*key)
    return counts.withColumn("index", ratio(F.col("n"), F.avg("n").over(group))).withColumn(
        "proportion", ratio(F.col("n"), F.sum("n").over(group))
    )


def peaks(index: DataFrame, key: Sequence[str], part: str, value: str = "index") -> DataFrame:
    """The part with the highest index per key, the smallest on ties."""
    return keep_first(index, key, [F.col(value).desc(), F.col(part)])


def peak_frequency(peak: DataFrame, part: str) -> DataFrame:
    counts = peak.groupBy(part).agg(F.count(F.lit(1)).alias("zones"))
    return share_within(counts, [], "zones", "_s").withColumn("pct", F.col("_s") * 100).drop("_s")


def group_mode(df: DataFrame, by: Sequence[str], value: str, out: str = "top", weight: str | None = None) -> DataFrame:
    """Most frequent value per group, the smallest on ties."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(counted(weight).alias("_n"))
    return keep_first(counts, by, [F.col("_n").desc(), F.col(value)]).select(*by, F.col(value).alias(out))


def concentration(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Herfindahl index and share of the largest label, per group."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return counts.groupBy(*by).agg(
        ratio(F.sum(F.col("_n") * F.col("_n")), F.sum("_n") * F.sum("_n")).alias("concentration"),
        ratio(F.max("_n"), F.sum("_n")).alias("dominance"),
    )


def monthly_stats(counts: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation, maximum and CV of the monthly counts."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return counts.groupBy(*key).agg(
        F.avg(value).alias("mean"), sd.alias("std"), F.max(value).alias("max"), ratio(sd, F.avg(value)).alias("cv")
    )


def consistency_of_stats(counts: DataFrame, key: Sequence[str], month: str, value: str) -> DataFrame:
    """1 / (1 + mean(std) / mean(mean)) over months, statistics across years.

    Months seen in one year only have no deviation and do not enter its mean.
    """
    per_month = counts.groupBy(*key, month).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    noise = ratio(F.avg("_s"), F.avg("_m"))
    return per_month.groupBy(*key).agg((1 / (1 + noise)).alias("consistency"))


def consistency_of_means(counts: DataFrame, key: Sequence[str], month: str, value: str, min_total: float | None = None) -> DataFrame:
    """1 / (1 + std / mean) of the mean count per calendar month."""
    per_month = counts.groupBy(*key, month).agg(F.avg(value).alias("_m"), F.sum(value).alias("_t"))
    out = per_month.groupBy(*key).agg(
        (1 / (1 + ratio(F.stddev_samp("_m"), F.avg("_m")))).alias("consistency"), F.sum("_t").alias("_total")
    )
    if min_total is not None:
        out = out.filter(F.col("_total") >= min_total)
    return out.drop("_total")


def zone_stability(counts: DataFrame, zone: str, value: str) -> DataFrame:
    return counts.groupBy(zone).agg(
        stability(F.count(value), F.avg(value), F.stddev_samp(value)).alias("stability")
    )


def column_profile(df: DataFrame, columns: Sequence[str], limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row per column: non-null, null, zero, distinct, min, max, out of range."""
    limits = limits or {}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    v = F.col("value")
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (a, b) in limits.items():
        low = F.when(F.col("column") == name, F.lit(float(a))).otherwise(low)
        high = F.when(F.col("column") == name, F.lit(float(b))).otherwise(high)
    outside = (v < low) | (v > high)
    # counting values first makes the distinct count an ordinary sum
    cells = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    return cells.groupBy("column").agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), F.col("_n"))), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(v.isNull(), F.col("_n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(v == 0, F.col("_n"))), F.lit(0)).alias("zeros"),
        F.count("value").alias("distinct"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.coalesce(F.sum(F.when(outside, F.col("_n"))), F.lit(0)).alias("outside"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys occur more than once, and how many rows they hold."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_rows"),
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return share_within(counts, [], "n")


def distinct_counts(df: DataFrame, by: Sequence[str], column: str, out: str) -> DataFrame:
    """Exact distinct count per group: distinct pairs first, so a hot group is
    counted by many tasks."""
    pairs = df.filter(F.col(column).isNotNull()).select(*by, column).distinct()
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def conditional_counts(df: DataFrame, by: Sequence[str], tests: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
