"""Forecast post-processing, baselines and validation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.functions.numbers import clip
from zonetide.functions.stats import safe_corr
from zonetide.operators.ranking import column_quantiles, one_row, quantiles, scalar_quantile

# Decay and season of the blended forecast.
HORIZON, DECAY_AFTER, DECAY_STEP, SEASON_GAIN, SEASON_DAYS = 210, 120, 0.003, 0.2, 30


def horizon_factor(horizon: int = HORIZON) -> Column:
    """Mean over the horizon of decay times season, folded over a sequence."""
    days = F.sequence(F.lit(0), F.lit(horizon - 1))
    total = F.aggregate(
        days, F.lit(0.0),
        lambda s, d: s + F.when(d < DECAY_AFTER, 1.0).otherwise(1.0 - (d - DECAY_AFTER) * DECAY_STEP)
        * (1.0 + F.sin(d * (2 * math.pi) / SEASON_DAYS) * SEASON_GAIN),
    )
    return total / horizon


def blended_forecast(history: DataFrame, zone: str, value: str, model: str, change: str, horizon: int = HORIZON) -> DataFrame:
    """0.8 of the historic mean and 0.06 of the model, decayed, raised where the
    label may change, and capped at 1.2 times the largest value seen.

    ``history`` is the long panel; ``model`` and ``change`` are columns of it
    that are constant per zone.
    """
    top = history.select(F.max(value)).scalar() * 1.2
    zones = history.groupBy(zone).agg(
        F.avg(value).alias("mean"), F.max(value).alias("peak"), F.stddev_pop(value).alias("sd"),
        F.max(model).alias("model"), F.max(change).alias("change"),
    )
    start = F.least(F.greatest(F.col("mean") * 0.8 + F.col("model") * 0.3 * 0.2, F.lit(0.0)), top)
    lift = 1 + clip(F.col("change").cast("double"), 0.0, 1.0) * 0.3
    return zones.select(
        zone, F.least(F.greatest(start * horizon_factor(horizon) * lift, F.lit(0.0)), top).alias("forecast"),
        clip(F.col("change").cast("double"), 0.0, 1.0).alias("change"), (F.col("sd") / (F.col("peak") + 1e-6)).alias("volatility"),
    )


def directions(periods: DataFrame, zone: str, period: str, actual: str, predicted: str, stable: float) -> DataFrame:
    """Sign of the actual and predicted change to the previous period."""
    w = Window.partitionBy(zone).orderBy(period)
    base = F.lag(actual).over(w).cast("double")

    def sign(now: Column) -> Column:
        step = now - F.col("_base")
        return F.when(F.abs(step) <= stable, 0).otherwise(F.signum(step).cast("int")).cast("int")

    rows = periods.withColumn("_base", base).filter(F.col("_base").isNotNull())
    return rows.withColumn("actual_sign", sign(F.col(actual))).withColumn("predicted_sign", sign(F.col(predicted))).drop("_base")


def direction_accuracy(signs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = (F.col("actual_sign") == F.col("predicted_sign")).cast("double")
    return signs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(hit) * 100).alias("accuracy"), safe_corr("actual_sign", "predicted_sign").alias("r"),
    )


def confusion(signs: DataFrame) -> DataFrame:
    return signs.groupBy("actual_sign").agg(
        F.count_if(F.col("predicted_sign") == -1).alias("down"), F.count_if(F.col("predicted_sign") == 0).alias("same"),
        F.count_if(F.col("predicted_sign") == 1).alias("up"),
    )


BLOCK = 64  # values of a block of the exponential mean


def ema_baseline(series: DataFrame, zone: str, order: str, value: str, alpha: float) -> DataFrame:
    """Exponential mean of all rows up to the one before, per row.

    A linear recurrence in two steps: decayed sums inside blocks of ``BLOCK`` values, and
    what each block carries to the next, folded once per zone over its blocks.  Null
    values are passed over; the mean starts at the first value.
    """
    rows_before = Window.partitionBy(zone).orderBy(order)
    in_block = Window.partitionBy(zone, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    y, keep = F.col(value).cast("double"), 1 - alpha
    step = lambda s, v: s * keep + v * alpha
    rows = series.withColumn("_b", F.floor((F.count(y).over(rows_before.rowsBetween(Window.unboundedPreceding, 0)) - 1) / BLOCK))
    rows = rows.withColumn("_past", F.collect_list(y).over(in_block)).withColumn("_k", F.size("_past")).withColumn("_s", F.aggregate("_past", F.lit(0.0), step)).drop("_past")
    ends = rows.filter(y.isNotNull()).groupBy(zone, "_b").agg(F.max("_k").alias("k"), F.max_by("_s", "_k").alias("s"), F.min_by(y, "_k").alias("v"))
    blocks = ends.groupBy(zone).agg(F.array_sort(F.collect_list(F.struct("_b", "k", "s", "v"))).alias("_all"))
    # the first block starts from its first value, each other one from the mean at the end of the one before
    start = F.array(F.element_at("_all", 1)["v"])
    carried = F.aggregate("_all", start, lambda c, e: F.concat(c, F.array(e["s"] + F.pow(F.lit(keep), e["k"]) * F.element_at(c, -1))))
    into = blocks.select(F.col(zone).alias("_z"), F.posexplode(carried).alias("_i", "_c"))
    met = rows.join(into, F.col(zone).eqNullSafe(F.col("_z")) & (F.col("_b") == F.col("_i")), "left")
    mean = F.when(y.isNotNull(), F.col("_s") + F.pow(F.lit(keep), F.col("_k")) * F.col("_c"))
    last = F.last("_ema", ignorenulls=True).over(rows_before.rowsBetween(Window.unboundedPreceding, -1))
    return met.withColumn("_ema", mean).withColumn("ema", last).select(*series.columns, "ema")


def linear_baseline(series: DataFrame, zone: str, order: str, value: str) -> DataFrame:
    """Straight-line forecast of each row from all rows before it."""
    w = Window.partitionBy(zone).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x, y = F.col(order).cast("double"), F.col(value).cast("double")
    n = F.count(y).over(w)
    mx, my = F.avg(x).over(w), F.avg(y).over(w)
    cov = F.avg(x * y).over(w) - mx * my
    var = F.avg(x * x).over(w) - mx * mx
    slope = F.when(n >= 2, F.try_divide(cov, var))
    return series.withColumn("linear", my + slope * (x - mx))


def errors(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    gap = F.col(predicted) - F.col(actual)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
    )


def alignment_gaps(df: DataFrame, predicted: str, action: str) -> DataFrame:
    """High prediction without action, and low prediction with much action."""
    q = column_quantiles(df, {"hi": (predicted, 0.75), "lo": (predicted, 0.25), "much": (action, 0.75)})
    gap = (F.col(predicted) > q["hi"]) & (F.col(action) == 0)
    surplus = (F.col(predicted) < q["lo"]) & (F.col(action) > q["much"])
    kind = F.when(gap, "gap").when(surplus, "surplus")
    return df.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def fixed_gaps(df: DataFrame, predicted: str, action: str) -> DataFrame:
    """The same with fixed cut-offs: > 0.8 with < 5, < 0.3 with > 10."""
    kind = F.when((F.col(predicted) > 0.8) & (F.col(action) < 5), "gap").when((F.col(predicted) < 0.3) & (F.col(action) > 10), "surplus")
    return df.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def quantile_classes(df: DataFrame, value: str, out: str = "class", override: tuple[float, float] | None = None) -> DataFrame:
    """Above p90 critical, p75 high, p50 medium, else low.

    ``override`` (p, factor) adds a flag ``critical`` for values of quantile(p) *
    factor or more, which are critical in any case; all cuts come from one pass.
    """
    levels = {"p50": 0.5, "p75": 0.75, "p90": 0.9} | ({"over": override[0]} if override else {})
    cut = one_row(quantiles(df, value, levels))
    v = F.col(value)
    if override:
        rows = df.withColumn("critical", v >= cut["over"] * override[1])
        return rows.withColumn(out, F.when(F.col("critical") | (v > cut["p90"]), "CRITICO").when(v > cut["p75"], "ALTO").when(v > cut["p50"], "MEDIO").otherwise("BAIXO"))
    return df.withColumn(out, F.when(v > cut["p90"], "CRITICO").when(v > cut["p75"], "ALTO").when(v > cut["p50"], "MEDIO").otherwise("BAIXO"))


def critical_override(df: DataFrame, value: str, cls: str, p: float = 0.9, factor: float = 1.15) -> DataFrame:
    """Values at or above quantile(p) * factor become critical."""
    bound = scalar_quantile(df, value, p) * factor
    return df.withColumn("critical", F.col(value) >= bound).withColumn(cls, F.when(F.col("critical"), "CRITICO").otherwise(F.col(cls)))


def totals_check(df: DataFrame, predicted: str, observed: str, without: str) -> DataFrame:
    row = df.agg(F.sum(predicted).alias("predicted"), F.sum(observed).alias("observed"), F.sum(without).alias("without"))
    return row.withColumn("predicted_minus_observed", F.col("predicted") - F.col("observed")).withColumn(
        "without_minus_observed", F.col("without") - F.col("observed")
    )


def weighted_loss(df: DataFrame, actual: str, predicted: str, changed: str, stable_days: str) -> DataFrame:
    """(1 + 2 change + 0.5 (1 - days/365)) times the squared error."""
    weight = 1 + F.col(changed) * 2 + (1 - F.col(stable_days) / 365) * 0.5
    gap = F.col(predicted) - F.col(actual)
    return df.withColumn("loss", weight * gap * gap)
