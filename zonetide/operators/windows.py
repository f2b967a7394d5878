"""Window features of a dense panel (one row per zone and date)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.functions.dates import cyclic
from zonetide.functions.numbers import clip, intensity, ratio
from zonetide.operators.ranking import average_rank, one_row, quantiles


def _by(zone: str, date: str):
    return Window.partitionBy(zone).orderBy(date)


def lags(panel: DataFrame, zone: str, date: str, columns: Sequence[str], steps: Sequence[int]) -> DataFrame:
    w = _by(zone, date)
    return panel.withColumns(
        {f"{c}_lag{k}": F.coalesce(F.lag(c, k).over(w), F.lit(0)).cast("double") for c in columns for k in steps}
    )


def trailing_means(panel: DataFrame, zone: str, date: str, columns: Sequence[str], widths: Sequence[int]) -> DataFrame:
    w = _by(zone, date)
    return panel.withColumns({f"{c}_ma{k}": F.avg(c).over(w.rowsBetween(-(k - 1), 0)) for c in columns for k in widths})


def trailing_volatility(panel: DataFrame, zone: str, date: str, columns: Sequence[str], width: int = 7) -> DataFrame:
    frame = _by(zone, date).rowsBetween(-(width - 1), 0)
    return panel.withColumns({f"{c}_vol{width}": F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0)) for c in columns})


def all_features(panel: DataFrame, zone: str, date: str, columns: Sequence[str]) -> DataFrame:
    """Lags, means, volatility, intensity and cycles from one sorted exchange."""
    out = lags(panel, zone, date, columns, (1, 7, 30))
    out = trailing_means(out, zone, date, columns, (7, 30))
    out = trailing_volatility(out, zone, date, columns, 7)
    a, b, c = (F.col(x) for x in columns[:3])
    return out.withColumn("intensity", intensity(a, b, c)).withColumns(cyclic(date))


def trailing_count(panel: DataFrame, zone: str, date: str, value: str, days: int, inclusive: bool = False, out: str = "trailing") -> DataFrame:
    """Sum over ``[d - days, d)``, or ``[d - days + 1, d]`` when inclusive.

    The frame runs over calendar days, so the panel may have gaps.
    """
    w = Window.partitionBy(zone).orderBy(F.unix_date(date))
    frame = w.rangeBetween(-(days - 1), 0) if inclusive else w.rangeBetween(-days, -1)
    return panel.withColumn(out, F.coalesce(F.sum(value).over(frame), F.lit(0)).cast("bigint"))


def percent_rank_per_day(panel: DataFrame, date: str, value: str, out: str = "pct") -> DataFrame:
    return average_rank(panel, value, [date], out, percent=True)


def quartile_scale_per_day(panel: DataFrame, date: str, value: str, out: str = "scaled") -> DataFrame:
    """clip((x - p25) / (p75 - p25), 0, 1) with quartiles of the day's non-zeros.

    Values stay as they are on days where the quartiles coincide or are missing.
    """
    q = quantiles(panel.filter(F.col(value) > 0), value, {"p25": 0.25, "p75": 0.75}, [date])
    x = F.col(value).cast("double")
    spread = F.col("p75") - F.col("p25")
    scaled = clip(F.try_divide(x - F.col("p25"), spread), 0.0, 1.0)
    return panel.join(q, date, "left").withColumn(out, F.when(spread > 0, scaled).otherwise(x)).drop("p25", "p75")


def centred_mean(panel: DataFrame, zone: str, date: str, value: str, reach: int = 1, out: str = "smooth") -> DataFrame:
    return panel.withColumn(out, F.avg(value).over(_by(zone, date).rowsBetween(-reach, reach)))


def label_changes(snapshots: DataFrame, zone: str, date: str, labels: str) -> DataFrame:
    """One row per new label of a zone whose label set differs from before.

    A zone that loses all its labels changes to none: an empty set at a snapshot
    gives one row with a null new label.
    """
    before = F.lag(labels).over(_by(zone, date))
    return (
        snapshots.withColumn("_old", before)
        .filter(F.col("_old").isNotNull() & (F.col("_old") != F.col(labels)))
        .select(
            zone,
            date,
            F.try_element_at(F.array_sort("_old"), F.lit(1)).alias("old_label"),
            F.explode(F.when(F.size(labels) == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_except(labels, "_old"))).alias("new_label"),
        )
    )


def complete_labels(snapshots: DataFrame, zone: str, date: str, labels: str) -> DataFrame:
    """Every zone at every snapshot; without a row there it has no labels.

    The snapshot dates travel as one array, which is as long as the calendar.
    """
    days = one_row(snapshots.agg(F.array_sort(F.collect_set(date)).alias("days")))["days"]
    grid = snapshots.select(zone).distinct().withColumn(date, F.explode(days))
    none = F.array().cast(dict(snapshots.dtypes)[labels])
    return grid.join(snapshots.select(zone, date, labels), [zone, date], "left").withColumn(labels, F.coalesce(labels, none))


def label_risk(labels: Column, most: int = 3) -> Column:
    """Number of labels over ``most``, at most 1; 0 without any."""
    return F.when(labels.isNull(), 0.0).when(F.size(labels) > most, 1.0).otherwise(F.size(labels) / most)


def days_since_change(panel: DataFrame, zone: str, date: str, changed: str, cap: int = 365, out: str = "days_since") -> DataFrame:
    """Days since the last change up to today; ``cap`` when there was none."""
    frame = _by(zone, date).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(changed) > 0, F.col(date)), ignorenulls=True).over(frame)
    return panel.withColumn(out, F.coalesce(F.least(F.datediff(F.col(date), last), F.lit(cap)), F.lit(cap)))


def change_volatility(panel: DataFrame, zone: str, date: str, changed: str, days: int = 30, out: str = "change_volatility") -> DataFrame:
    frame = _by(zone, date).rowsBetween(-days, -1)
    return panel.withColumn(out, F.least(F.coalesce(F.sum(changed).over(frame), F.lit(0)) / float(days), F.lit(1.0)))


def next_deltas(series: DataFrame, zone: str, date: str, columns: Sequence[str]) -> DataFrame:
    """Next minus current value of each column; the last row of a zone drops."""
    w = _by(zone, date)
    out = series.withColumn("next_" + date, F.lead(date).over(w))
    out = out.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    out = out.filter(F.col("next_" + date).isNotNull())
    return out.withColumns({f"d_{c}": F.col(f"next_{c}") - F.col(c) for c in columns})


def first_differences(panel: DataFrame, zone: str, date: str, columns: Sequence[str]) -> DataFrame:
    """Difference to the same zone's previous row, null on its first."""
    w = _by(zone, date)
    return panel.withColumns({f"d_{c}": (F.col(c) - F.lag(c).over(w)).cast("double") for c in columns})


def first_last_trend(series: DataFrame, zone: str, date: str, value: str) -> DataFrame:
    first = F.min_by(value, date).cast("double")
    last = F.max_by(value, date).cast("double")
    return series.groupBy(zone).agg(((last - first) / F.greatest(first, F.lit(1.0))).alias("trend"))


def minmax_classes(panel: DataFrame, zone: str, date: str, value: str, days: int, to_class, last: Column | None = None) -> DataFrame:
    """Mean of the last days per zone, scaled over zones, with its class.

    ``last`` may name the last date where it is known more cheaply.
    """
    last = panel.select(F.max(date)).scalar() if last is None else last
    recent = panel.filter(F.col(date) > F.date_sub(last, days)).groupBy(zone).agg(F.avg(value).alias("level"))
    span = one_row(recent.agg(F.min("level").alias("low"), F.max("level").alias("high")))
    scaled = F.coalesce(ratio(F.col("level") - span["low"], span["high"] - span["low"]), F.lit(0.0))
    return recent.withColumn("scaled", scaled).withColumn("class", to_class(F.col("scaled")))


def fill_with_mean(df: DataFrame, value: str, out: str) -> DataFrame:
    """Missing values replaced by the mean of the present ones."""
    mean = df.select(F.avg(value)).scalar()
    return df.withColumn(out, F.coalesce(F.col(value).cast("double"), mean))


def window_compare(events: DataFrame, zone: str, date: str, start: Column, end: Column) -> DataFrame:
    """Counts in [start, end] and in the window of equal length before it."""
    days = F.datediff(end, start)
    before = F.date_sub(start, days)
    d = F.col(date)
    return events.filter(d.between(before, end)).groupBy(zone).agg(
        F.count_if(d >= start).alias("current"), F.count_if(d < start).alias("previous")
    )
