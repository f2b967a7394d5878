"""Dense zone x time panels and what learners need from them.

The long panel is keyed (zone, date).  Events are aggregated to that key first,
so a zone that holds a third of all events is one calendar of rows afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.functions.numbers import ratio
from zonetide.operators.ranking import one_row
from zonetide.session import cut_lineage

STEPS = {"day": "INTERVAL 1 DAY", "month": "INTERVAL 1 MONTH"}


def keyed_counts(events: DataFrame, keys: Sequence[str], count: str = "n", **aggs: Column) -> DataFrame:
    """One row per key with the event count and any further aggregates."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *[e.alias(n) for n, e in aggs.items()])


def bounds(df: DataFrame, date: str = "date") -> tuple[Column, Column]:
    """First and last date as fields of one scalar subquery."""
    row = one_row(df.agg(F.min(date).alias("first"), F.max(date).alias("last")))
    return row["first"], row["last"]


def densify(
    counts: DataFrame,
    zone: str,
    date: str,
    metrics: Sequence[str],
    low: Column | None = None,
    high: Column | None = None,
    step: str = "day",
) -> DataFrame:
    """Complete (zone, date) grid with zero-filled metrics.

    Each row emits its own date and the gap up to the zone's next date, so the
    grid needs neither a cross join nor a second shuffle: the output stays
    partitioned by zone for the windows that follow.  Rows without a date belong
    to no day and are left out.
    """
    counts = counts.filter(F.col(date).isNotNull())
    if low is not None:
        counts = counts.filter(F.col(date) >= low)
    if high is not None:
        counts = counts.filter(F.col(date) <= high)
    first, last = bounds(counts, date)
    low = first if low is None else low
    high = last if high is None else high
    interval = F.expr(STEPS[step])
    by_zone = Window.partitionBy(zone).orderBy(date)
    gaps = (
        counts.withColumn("_start", F.when(F.lag(date).over(by_zone).isNull(), low).otherwise(F.col(date)))
        .withColumn("_next", F.lead(date).over(by_zone))
        .withColumn("_stop", F.when(F.col("_next").isNull(), high).otherwise((F.col("_next") - interval).cast("date")))
    )
    own = F.col("_day") == F.col(date)
    kinds = dict(counts.dtypes)
    return gaps.withColumn("_day", F.explode(F.sequence("_start", "_stop", interval))).select(
        zone,
        F.col("_day").alias(date),
        *[F.when(own, F.coalesce(F.col(m), F.lit(0))).otherwise(F.lit(0)).cast(kinds[m]).alias(m) for m in metrics],
    )


def calendar_series(counts: DataFrame, date: str, metrics: Sequence[str], low: Column, high: Column, step: str = "day") -> DataFrame:
    """A single series over a fixed calendar, zero-filled."""
    spark = counts.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(low, high, F.expr(STEPS[step]))).alias(date))
    return calendar.join(counts, date, "left").na.fill(0, subset=list(metrics))


def with_seed_zones(counts: DataFrame, zones: DataFrame, zone: str, date: str, at: Column) -> DataFrame:
    """Add one zero row for every listed zone that has no row yet."""
    missing = zones.select(zone).distinct().join(counts.select(zone), zone, "left_anti")
    return counts.unionByName(missing.withColumn(date, at), allowMissingColumns=True)


def common_panel(
    a: DataFrame, b: DataFrame, zone: str, date: str, of_a: Sequence[str], of_b: Sequence[str], lagged: str | None = None
) -> DataFrame:
    """Panel of two sources on their common zones and common period.

    The period runs from the later first date to the earlier last date.  Both
    sources are stacked and summed by one shuffle and written; zones and period
    are then read off that small table.  A zero row at the first date keeps
    zones that are silent inside the period.
    """
    metrics = [*of_a, *of_b]
    stacked = a.withColumn("_a", F.lit(1)).unionByName(b.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    cells = cut_lineage(
        stacked.groupBy(zone, date).agg(
            *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in metrics], F.count("_a").alias("_a"), F.count("_b").alias("_b")
        ),
        "cells",
    )
    d, in_a, in_b = F.col(date), F.col("_a") > 0, F.col("_b") > 0
    ends = one_row(cells.agg(
        F.greatest(F.min(F.when(in_a, d)), F.min(F.when(in_b, d))).alias("low"),
        F.least(F.max(F.when(in_a, d)), F.max(F.when(in_b, d))).alias("high"),
    ))
    low, high = ends["low"], ends["high"]
    shared = cells.groupBy(zone).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).filter(in_a & in_b).select(zone)
    inside = cells.filter(d.between(low, high)).join(shared, zone, "left_semi").select(zone, date, *metrics)
    seeds = shared.withColumn(date, low)
    sums = inside.unionByName(seeds, allowMissingColumns=True).groupBy(zone, date).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in metrics])
    out = densify(sums, zone, date, metrics, low, high)
    if lagged:
        out = out.withColumn(f"{lagged}_before", F.lag(lagged, 1, 0).over(Window.partitionBy(zone).orderBy(date)))
    return out


def sliding_windows(panel: DataFrame, zone: str, date: str, value: str, width: int) -> DataFrame:
    """Array of the last ``width`` values for every full window."""
    frame = Window.partitionBy(zone).orderBy(date).rowsBetween(-(width - 1), 0)
    return panel.withColumn("window", F.collect_list(value).over(frame)).filter(F.size("window") == width).select(zone, date, "window")


def window_targets(panel: DataFrame, zone: str, date: str, value: str, width: int, horizon: int) -> DataFrame:
    """Windows with the value ``horizon`` rows later and the mean up to there."""
    by_zone = Window.partitionBy(zone).orderBy(date)
    back = by_zone.rowsBetween(-(width - 1), 0)
    ahead = by_zone.rowsBetween(1, horizon)
    return (
        panel.withColumn("window", F.collect_list(value).over(back))
        .withColumn("target_at", F.lead(value, horizon).over(by_zone))
        .withColumn("target_mean", F.avg(value).over(ahead))
        .withColumn("_n", F.count(value).over(ahead))
        .filter((F.size("window") == width) & (F.col("_n") == horizon))
        .select(zone, date, "window", "target_at", "target_mean")
    )


def temporal_split(panel: DataFrame, date: str, shares: Mapping[str, float], period: tuple[Column, Column] | None = None) -> DataFrame:
    """Label each date with its split, in time order; the last split is closed.

    On the dense grid the share of a date is its offset over the calendar, whose
    ends may be given where they are known more cheaply.
    """
    first, last = bounds(panel, date) if period is None else period
    place = F.datediff(F.col(date), first) / (F.datediff(last, first) + 1)
    names = list(shares)
    result, upto = None, 0.0
    for name in names[:-1]:
        upto += shares[name]
        test = place < F.lit(round(upto, 9))
        result = F.when(test, name) if result is None else result.when(test, name)
    return panel.withColumn("split", result.otherwise(names[-1]))


def standardise(panel: DataFrame, train: DataFrame, columns: Sequence[str], eps: float = 1e-5, skip_zeros: bool = False) -> DataFrame:
    """(x - mean) / (sd + eps) with statistics of the training rows only."""
    xs = {c: F.when(F.col(c) != 0, F.col(c)) if skip_zeros else F.col(c) for c in columns}
    stats = one_row(train.agg(*[F.avg(x).alias(f"{c}_m") for c, x in xs.items()], *[F.stddev_samp(x).alias(f"{c}_s") for c, x in xs.items()]))
    return panel.withColumns({f"{c}_std": (F.col(c) - stats[f"{c}_m"]) / (stats[f"{c}_s"] + eps) for c in columns})


def array_export(panel: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], chunk: Column) -> DataFrame:
    """Rows of one key as sorted arrays of structs.

    ``chunk`` bounds the length of an array, e.g. a range of zone ids; consumers
    read the chunks of a key in order.
    """
    cells = F.array_sort(F.collect_list(F.struct(order, *values))).alias("cells")
    return panel.groupBy(*keys, chunk.alias("chunk")).agg(cells)


def feature_columns(columns: Sequence[str], kinds: Sequence[str]) -> list[str]:
    """Pick feature columns by declared kind, in stable order.

    Kinds are matched on whole suffix tokens, so asking for ``norm`` does not
    pull in lags or volatilities of normalised columns.
    """
    tests = {
        "raw": lambda c: not any(t in c for t in ("_norm", "_lag", "_ma", "_vol")),
        "norm": lambda c: c.endswith("_norm"),
        "lag": lambda c: "_lag" in c,
        "ma": lambda c: "_ma" in c,
        "volatility": lambda c: c.endswith("_vol7"),
        "cyclic": lambda c: c in ("dow_sin", "dow_cos", "month_sin", "month_cos"),
        "intensity": lambda c: c == "intensity",
    }
    return [c for c in columns if any(tests[k](c) for k in kinds)]


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Unpivot numeric columns to (keys, feature, value)."""
    casted = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return casted.unpivot(list(keys), list(columns), name, value)


def validation_report(panel: DataFrame, zone: str, date: str, value: str, edges: DataFrame | None, width: int) -> DataFrame:
    """One row of checks on a panel and its graph, with the list of failures."""
    zones = panel.groupBy(zone).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(F.col(value) == 0, 0).otherwise(1)).alias("nonzero"),
        F.count_if(F.col(value).isNull() | F.isnan(F.col(value).cast("double"))).alias("bad"),
        F.count_if(F.col(value) < 0).alias("negative"),
    )
    report = zones.agg(
        F.count(F.lit(1)).alias("zones"),
        F.max("rows").alias("dates"),
        F.sum("rows").alias("cells"),
        F.sum("bad").alias("bad_values"),
        F.sum("negative").alias("negative_values"),
        F.count_if(F.col("nonzero") == 0).alias("silent_zones"),
    ).withColumn("windows", F.greatest(F.col("dates") - width + 1, F.lit(0)))
    if edges is not None:
        known = panel.select(F.col(zone).alias("_z")).distinct()
        stray = (
            edges.select("src").unionByName(edges.select(F.col("dst").alias("src")))
            .join(known, F.col("src") == F.col("_z"), "left_anti")
        )
        report = report.withColumn("stray_edge_ends", stray.select(F.count(F.lit(1))).scalar())
    else:
        report = report.withColumn("stray_edge_ends", F.lit(0).cast("bigint"))
    issues = F.array(
        F.when(F.col("cells") != F.col("zones") * F.col("dates"), "grid not complete"),
        F.when(F.col("bad_values") > 0, "missing values"),
        F.when(F.col("negative_values") > 0, "negative values"),
        F.when(F.col("silent_zones") > 0, "zones without events"),
        F.when(F.col("windows") == 0, "no full window"),
        F.when(F.col("stray_edge_ends") > 0, "edges to unknown zones"),
    )
    report = report.withColumn("issues", F.array_join(F.filter(issues, lambda i: i.isNotNull()), "; "))
    return report.withColumn("status", F.when(F.col("issues") == "", "ok").otherwise("check"))


def slice_zones(panel: DataFrame, keep: DataFrame, zone: str) -> DataFrame:
    """Rows of the kept zones."""
    return panel.join(keep.select(zone).distinct(), zone, "left_semi")


def relative_to_max(df: DataFrame, value: str, out: str = "index") -> DataFrame:
    """value / largest value, zero when everything is zero."""
    top = df.select(F.max(value)).scalar()
    return df.withColumn(out, F.coalesce(ratio(F.col(value), top), F.lit(0.0)))
