"""Correlation, seasonality, effect and trend studies over monthly counts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from zonetide.functions.ladders import ladder
from zonetide.functions.numbers import percent_change, ratio
from zonetide.functions.stats import safe_corr, student_p, t_of_r
from zonetide.operators.joins import month_number
from zonetide.operators.ranking import average_rank, one_row
from zonetide.operators.windows import next_deltas
from zonetide.session import cut_lineage


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form (a, b, r) of all column pairs, from one aggregation."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[safe_corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)
    ])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def grouped_correlation(df: DataFrame, by: Sequence[str], x: str, y: str, *more: Column) -> DataFrame:
    """Rows, Pearson r and any further aggregates per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr(x, y).alias("r"), *more)


def correlation_test(df: DataFrame, by: Sequence[str], x: str, y: str, *more: Column) -> DataFrame:
    """r with its two-sided p-value on n - 2 degrees of freedom."""
    out = grouped_correlation(df, by, x, y, *more)
    t = t_of_r(F.col("r"), F.col("n"))
    p = F.when(F.abs(F.col("r")) >= 1, F.lit(0.0)).otherwise(student_p(t, F.col("n") - 2))
    return out.withColumn("p", F.when((F.col("n") > 2) & F.col("r").isNotNull(), p))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks; a group is one calendar of rows."""
    ranked = average_rank(average_rank(df, x, by, "_rx", bounded=True), y, by, "_ry", bounded=True)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr("_rx", "_ry").alias("rho"))


def lagged_correlation(series: DataFrame, order: str, features: Sequence[str], outcome: str, lags: Sequence[int]) -> DataFrame:
    """r between a feature and the outcome ``lag`` rows later, by position.

    The series is one row per period, so its single window is as long as the
    calendar.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(order)
    shifted = series.withColumns({f"_y{k}": F.lead(outcome, k).over(w) for k in lags})
    row = shifted.agg(*[safe_corr(f, f"_y{k}").alias(f"{f}|{k}") for f in features for k in lags])
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(k).alias("lag"), F.col(f"`{f}|{k}`").alias("r")) for f in features for k in lags
    ])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def autocorrelation(series: DataFrame, order: str, value: str, max_lag: int) -> DataFrame:
    """ACF with the global mean and the full sum of squares as denominator.

    The self-join is keyed by (position + lag), so every lag is an equi-join.
    """
    mean = series.select(F.avg(value)).scalar()
    total = series.select((F.var_pop(value) * F.count(value))).scalar()
    w = Window.partitionBy(F.lit(1)).orderBy(order)
    placed = series.select(F.row_number().over(w).alias("t"), (F.col(value) - mean).alias("x"))
    ahead = placed.select(F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"), (F.col("t")).alias("t0"), F.col("x").alias("x0"))
    joined = ahead.withColumn("t", F.col("t0") + F.col("lag")).join(placed, "t")
    return joined.groupBy("lag").agg(F.try_divide(F.sum(F.col("x0") * F.col("x")), F.first(total)).alias("acf"))


def profile_comparison(a: DataFrame, b: DataFrame, zone: str, month: str, value: str) -> DataFrame:
    """Compare the 12-month profiles of zones present in both; missing = 0.

    Sums over twelve calendar months are written with the number twelve, so the
    empty months need no rows.
    """
    left = a.select(zone, month, F.col(value).cast("double").alias("x"))
    right = b.select(zone, month, F.col(value).cast("double").alias("y"))
    cells = left.unionByName(right, allowMissingColumns=True).groupBy(zone, month).agg(
        F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"), F.count("x").alias("_nx"), F.count("y").alias("_ny")
    )
    sx, sy = F.sum("x"), F.sum("y")
    cov = F.sum(F.col("x") * F.col("y")) - sx * sy / 12
    vx = F.sum(F.col("x") * F.col("x")) - sx * sx / 12
    vy = F.sum(F.col("y") * F.col("y")) - sy * sy / 12
    gap = F.abs(F.col("x") - F.col("y"))
    out = cells.groupBy(zone).agg(
        F.when((vx > 1e-9) & (vy > 1e-9), F.try_divide(cov, F.sqrt(vx * vy))).alias("r"),
        (F.sum(gap) / 12).alias("mean_abs"), F.max(gap).alias("max_abs"),
        F.count_if(F.col("x") != 0).alias("months_x"), F.count_if(F.col("y") != 0).alias("months_y"),
        F.sum("_nx").alias("_nx"), F.sum("_ny").alias("_ny"),
    )
    return out.filter((F.col("_nx") > 0) & (F.col("_ny") > 0)).drop("_nx", "_ny")


# Correlation bands of the effect class.
EFFECT_CLASSES = {"very_high": "MUITO ALTA", "high": "ALTA", "useless": "INEFICAZ", "low": "BAIXA", "neutral": "NEUTRA"}


def effect_class(r: Column) -> Column:
    c = EFFECT_CLASSES
    return (
        F.when(r < -0.5, c["very_high"]).when(r < -0.2, c["high"]).when(r > 0.5, c["useless"])
        .when(r > 0.2, c["low"]).otherwise(c["neutral"])
    )


def effectiveness(pairs: DataFrame, by: Sequence[str], treatment: str, outcome: str, min_periods: int = 4) -> DataFrame:
    """Correlation test, totals, means, -sum(y)/sum(x) and the effect class."""
    out = correlation_test(
        pairs, by, treatment, outcome,
        F.sum(outcome).alias("total_outcome"), F.sum(treatment).alias("total_treatment"),
        F.avg(outcome).alias("mean_outcome"), F.avg(treatment).alias("mean_treatment"),
    ).filter((F.col("n") >= min_periods) & F.col("r").isNotNull())
    reduction = F.coalesce(ratio(-F.col("total_outcome"), F.col("total_treatment")), F.lit(0.0))
    return out.withColumn("reduction", reduction).withColumn("class", effect_class(F.col("r")))


def before_after(treatment: DataFrame, outcome: DataFrame, zone: str, month: str, x: str, y: str, p: float = 0.75) -> DataFrame:
    """Outcome before and after the months whose treatment is at or above the
    zone's own quantile.

    Both series are stacked by (zone, month); the neighbouring months are frames
    of one calendar month, so a zone is shuffled once and is as long as the
    calendar.
    """
    both = treatment.unionByName(outcome, allowMissingColumns=True).groupBy(zone, month).agg(F.max(x).alias(x), F.max(y).alias(y))
    w = Window.partitionBy(zone).orderBy(month_number(month))
    marked = both.withColumns({
        "_cut": F.percentile(x, F.lit(p)).over(Window.partitionBy(zone)),
        "prev": F.max(y).over(w.rangeBetween(-1, -1)), "next": F.max(y).over(w.rangeBetween(1, 1)),
    })
    return marked.filter((F.col(x) >= F.col("_cut")) & F.col("prev").isNotNull() & F.col("next").isNotNull()).select(zone, month, x, "prev", "next")


def before_after_mean(pairs: DataFrame, zone: str) -> DataFrame:
    drop = F.col("prev") - F.col("next")
    return pairs.groupBy(zone).agg(F.count(F.lit(1)).alias("pairs"), F.avg(drop).alias("mean_drop"))


def paired_test(pairs: DataFrame, zone: str) -> DataFrame:
    """Mean, median, share of drops and paired t-test, from two pairs on."""
    drop = (F.col("prev") - F.col("next")).cast("double")
    out = pairs.groupBy(zone).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(drop).alias("mean_drop"), F.median(drop).alias("median_drop"),
        F.avg((drop > 0).cast("double")).alias("share_drop"), F.stddev_samp(drop).alias("_sd"),
    ).filter(F.col("pairs") >= 2)
    t = F.try_divide(F.col("mean_drop") * F.sqrt(F.col("pairs").cast("double")), F.col("_sd"))
    return out.withColumn("t", t).withColumn("p", student_p(F.col("t"), F.col("pairs") - 1)).drop("_sd")


def impact_patterns(pairs: DataFrame, zone: str, month: str, treatment: str, outcome: str, least: float = 30.0) -> DataFrame:
    """Consecutive rows where treatment rose and the outcome fell, or rose by
    more than ``least`` percent."""
    d = next_deltas(pairs, zone, month, [treatment, outcome])
    change = percent_change(F.col("next_" + outcome), F.col(outcome), "unit")
    rise = percent_change(F.col("next_" + treatment), F.col(treatment), "unit")
    kind = F.when(F.col("d_" + outcome) < 0, "positive").when((F.col("d_" + outcome) > 0) & (change > least), "negative")
    return (
        d.filter(F.col("d_" + treatment) > 0).withColumn("outcome_pct", change).withColumn("treatment_pct", rise)
        .withColumn("kind", kind).filter(F.col("kind").isNotNull())
    )


def divergences(pairs: DataFrame, zone: str, month: str, treatment: str, outcome: str, least: float = 30.0) -> DataFrame:
    """Consecutive rows moving in opposite directions beyond +-``least`` percent."""
    d = next_deltas(pairs, zone, month, [treatment, outcome])
    px = percent_change(F.col("next_" + treatment), F.col(treatment), "unit")
    py = percent_change(F.col("next_" + outcome), F.col(outcome), "unit")
    opposite = ((px > least) & (py < -least)) | ((px < -least) & (py > least))
    return d.withColumn("treatment_pct", px).withColumn("outcome_pct", py).filter(opposite)


def trend_card(monthly: DataFrame, zone: str, month: str, value: str) -> DataFrame:
    """Latest month with its change to the previous month and the same month a
    year before, and the totals of the last two years."""
    # a zone has one row per month: one shuffle serves the window and the group
    latest = monthly.withColumn("latest_month", F.max(month).over(Window.partitionBy(zone)))
    year = F.year("latest_month")
    card = latest.groupBy(zone).agg(
        F.max("latest_month").alias("latest_month"),
        F.sum(F.when(F.col(month) == F.col("latest_month"), F.col(value))).alias("latest"),
        F.coalesce(F.sum(F.when(F.col(month) == F.add_months("latest_month", -1), F.col(value))), F.lit(0)).alias("prev_month"),
        F.sum(F.when(F.col(month) == F.add_months("latest_month", -12), F.col(value))).alias("prev_year_month"),
        F.sum(F.when(F.year(month) == year, F.col(value))).alias("last_year"),
        F.coalesce(F.sum(F.when(F.year(month) == year - 1, F.col(value))), F.lit(0)).alias("prev_year"),
        F.sum(value).alias("total"),
    )
    return card.withColumns({
        "month_change": ratio(F.col("latest") - F.col("prev_month"), F.col("prev_month")),
        "year_month_change": ratio(F.col("latest") - F.col("prev_year_month"), F.col("prev_year_month")),
        "year_change": ratio(F.col("last_year") - F.col("prev_year"), F.col("prev_year")),
    })


def share_shift(events: DataFrame, zone: str, part: str, recent: Column, weight: str | None = None) -> DataFrame:
    """The part whose share grew most from the baseline to the recent rows.

    Ties go to the smaller part; zones lacking either period are left out.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    counts = events.groupBy(zone, part).agg(F.sum(F.when(recent, one).otherwise(0)).alias("_r"), F.sum(F.when(recent, 0).otherwise(one)).alias("_b"))
    sums = counts.groupBy(zone).agg(F.sum("_r").alias("_tr"), F.sum("_b").alias("_tb")).filter((F.col("_tr") > 0) & (F.col("_tb") > 0))
    shift = F.col("_r") / F.col("_tr") - F.col("_b") / F.col("_tb")
    cells = counts.join(sums, zone).withColumn("shift", F.round(shift, 12))
    best = F.min(F.struct((-F.col("shift")).alias("m"), F.col(part).alias("p")))
    return cells.groupBy(zone).agg(best.alias("_b")).select(zone, F.col("_b.p").alias(part), (-F.col("_b.m")).alias("shift"))


def linear_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r, standard error and p of a simple regression."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    out = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(xs).alias("_mx"), F.avg(ys).alias("_my"),
        F.covar_pop(xs, ys).alias("_c"), F.var_pop(xs).alias("_vx"), F.var_pop(ys).alias("_vy"), safe_corr(x, y).alias("r"),
    )
    out = out.withColumn("slope", F.try_divide("_c", "_vx"))
    left = F.col("_vy") - F.col("slope") * F.col("_c")
    # an exact fit leaves rounding noise only
    left = F.when(left > F.col("_vy") * 1e-12, left).otherwise(0.0)
    out = out.withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx")).withColumn(
        "stderr", F.sqrt(F.try_divide(left, F.col("_vx") * F.when(F.col("n") > 2, F.col("n") - 2)))
    )
    p = student_p(F.try_divide("slope", "stderr"), F.col("n") - 2)
    exact = (F.col("stderr") == 0) & (F.col("slope") != 0)
    return out.withColumn("p", F.when(exact, 0.0).otherwise(p)).drop("_mx", "_my", "_c", "_vx", "_vy")


DF_CRITICAL = -2.86  # Fixed value: 5 % point of the Dickey-Fuller t with constant.


def dickey_fuller(series: DataFrame, zone: str, date: str, value: str) -> DataFrame:
    """Lag-free Dickey-Fuller t per zone from regression sums."""
    w = Window.partitionBy(zone).orderBy(date)
    steps = series.withColumn("_lag", F.lag(value).over(w).cast("double")).withColumn("_d", F.col(value).cast("double") - F.col("_lag"))
    fit = linear_fit(steps, [zone], "_lag", "_d")
    return fit.select(zone, "n", F.try_divide("slope", "stderr").alias("t")).withColumn("stationary", F.col("t") < DF_CRITICAL)


# The published response surface of the p-value of the Dickey-Fuller t with
# constant, as the argument of the normal distribution: below and above one point, between two ends.
SURFACE_LOW, SURFACE_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
SURFACE_SPLIT, SURFACE_ENDS = -1.61, (-18.83, 2.74)
PIVOT = 1e-10  # a column with less than this left of its square is a sum of earlier ones


def unit_root_p(t: Column) -> Column:
    """p-value of the Dickey-Fuller t with constant."""

    def surface(factors: Sequence[float]) -> Column:
        out = F.lit(0.0)
        for f in reversed(factors):
            out = out * t + f
        return out

    z = F.when(t <= SURFACE_SPLIT, surface(SURFACE_LOW)).otherwise(surface(SURFACE_HIGH))
    both = student_p(z, F.lit(1e12))  # as good as normal
    inside = F.when(z < 0, both / 2).otherwise(1 - both / 2)
    return F.when(t < SURFACE_ENDS[0], 0.0).when(t > SURFACE_ENDS[1], 1.0).otherwise(inside)


def _moments(rows: DataFrame, zone: str, columns: Sequence[Column]) -> DataFrame:
    """Per zone the number of rows, ``_top``, and the sums of all products of two columns, row by row of the lower triangle."""
    held = rows.select(zone, "_top", *(c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    pairs = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(len(columns)) for j in range(i + 1)]
    return held.groupBy(zone).agg(F.count(F.lit(1)).alias("_n"), F.max("_top").alias("_top"), F.array(*pairs).alias("_g"))


def _triangles(sums: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Cholesky factors of all zones at once and the square of the target; a column that earlier ones give is left out (zeros)."""
    flat = np.array(sums.tolist(), float)
    size = int((2 * flat.shape[1]) ** 0.5)
    g = np.zeros((len(flat), size, size))
    g[:, *np.tril_indices(size)] = flat
    low = np.zeros_like(g)
    for j in range(size):
        left = g[:, j, j] - (low[:, j, :j] ** 2).sum(axis=1)
        pivot = np.where(left > PIVOT * g[:, j, j], np.sqrt(np.maximum(left, 0)), 0)
        rest = g[:, j + 1 :, j] - (low[:, j + 1 :, :j] * low[:, j : j + 1, :j]).sum(axis=2)
        low[:, j, j] = pivot
        low[:, j + 1 :, j] = np.where(pivot[:, None] > 0, rest / np.where(pivot, pivot, 1)[:, None], 0)
    return low, g[:, -1, -1]


@F.pandas_udf(T.IntegerType())
def _order_of(sums: pd.Series, n: pd.Series, top: pd.Series) -> pd.Series:
    """The order with the least AIC: columns are the constant, the level, one difference after the other, and the target."""
    low, total = _triangles(sums)
    n, top = n.to_numpy(), top.to_numpy()
    target = low.shape[1] - 1
    rest = total[:, None] - np.cumsum(low[:, target, :target] ** 2, axis=1)
    sound = np.logical_and.accumulate(low[:, range(target), range(target)] > 0, axis=1)
    used = np.arange(1, target + 1)
    good = sound & (used - 2 <= top[:, None]) & (n[:, None] > used + 1) & (rest > 1e-12)
    aic = np.where(good, n[:, None] * np.log(np.where(good, rest, 1) / n[:, None]) + 2 * used, np.inf)[:, 1:]
    best = pd.Series(aic.argmin(axis=1), dtype="Int32")
    return best.where(np.isfinite(aic.min(axis=1)), pd.NA)


@F.pandas_udf(T.DoubleType())
def _level_t(sums: pd.Series, n: pd.Series, lag: pd.Series) -> pd.Series:
    """t of the level, which is the last column before the target; differences beyond ``lag`` are zeros."""
    low, total = _triangles(sums)
    target = low.shape[1] - 1
    free = n.to_numpy() - lag.to_numpy() - 2
    rest = total - (low[:, target, :target] ** 2).sum(axis=1)
    rank = (low[:, range(target), range(target)] > 0).sum(axis=1)
    good = (rank == lag.to_numpy() + 2) & (rest > 1e-12) & (free > 0)
    t = low[:, target, target - 1] / np.sqrt(np.where(good, rest, 1) / np.where(good, free, 1))
    return pd.Series(t).where(good)


def augmented_dickey_fuller(series: DataFrame, zone: str, date: str, value: str, max_lag: int | None = None, lag: int | None = None) -> DataFrame:
    """(zone, t, lag, p, stationary): the Dickey-Fuller t with ``lag`` differences, or as many as AIC prefers.

    Without ``lag`` all orders up to ``max_lag``, or 12 (n / 100)^(1/4), are compared on
    common rows, and t comes from all rows the chosen one can use.  A regression is sums
    of products per zone and a triangle of them; the triangle of the longest order
    holds those of all shorter ones.  ``p`` is the published response surface, a zone is
    ``stationary`` below 0.05.  Series that are constant, exactly fitted or too short have neither.
    """
    w = Window.partitionBy(zone).orderBy(date)
    whole = Window.partitionBy(zone)
    # the constant of the regression makes the level free, so the mean goes first
    y = F.col(value).cast("double")
    rows = series.select(zone, date, (y - F.avg(y).over(whole)).alias("_y"), F.count(F.lit(1)).over(whole).alias("_all"))
    rows = rows.withColumn("_lag", F.lag("_y").over(w)).withColumn("_d", F.col("_y") - F.col("_lag")).withColumn("_j", F.row_number().over(w) - 2)
    if lag is not None:
        top = F.lit(lag)
    elif max_lag is not None:
        top = F.lit(max_lag)
    else:
        top = F.greatest(F.least(F.ceil(12 * F.pow(F.col("_all") / 100, 0.25)), F.floor(F.col("_all") / 2) - 2), F.lit(0))
    rows = rows.withColumn("_top", top.cast("int"))
    longest = rows.agg(F.max("_top")).first()[0] or 0
    rows = rows.withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(1, longest + 1)})
    rows = cut_lineage(rows.filter(F.col("_j") >= 0), "differences")

    def lagged(most: Column) -> list[Column]:
        return [F.when(F.lit(k) <= most, F.col(f"_d{k}")).otherwise(0.0) for k in range(1, longest + 1)]

    if lag is None:
        columns = [F.lit(1.0), F.col("_lag"), *lagged(F.col("_top")), F.col("_d")]
        sums = _moments(rows.filter(F.col("_j") >= F.col("_top")), zone, columns)
        chosen = sums.select(F.col(zone).alias("_z"), _order_of("_g", "_n", "_top").alias("lag")).filter("lag is not null")
    else:
        chosen = rows.select(F.col(zone).alias("_z")).distinct().withColumn("lag", F.lit(lag))
    used = rows.join(chosen, F.col(zone).eqNullSafe(F.col("_z"))).filter(F.col("_j") >= F.col("lag")).withColumn("_top", F.col("lag"))
    sums = _moments(used, zone, [F.lit(1.0), *lagged(F.col("lag")), F.col("_lag"), F.col("_d")])
    tested = sums.select(F.col(zone).alias("_z"), _level_t("_g", "_n", "_top").alias("t"), F.col("_top").alias("lag"))
    tested = tested.filter("t is not null and not isnan(t)").withColumn("p", unit_root_p(F.col("t"))).withColumn("stationary", F.col("p") < 0.05)
    return series.select(zone).distinct().join(tested, F.col(zone).eqNullSafe(F.col("_z")), "left").drop("_z")


def viability_a(panel: DataFrame, date: str, total: str, outcome: str) -> DataFrame:
    """Sparsity, signal, CV and correlation of daily sums, scored 0.4/0.3/0.3."""
    daily = panel.groupBy(date).agg(
        F.sum(total).alias("_t"), F.sum(outcome).alias("_o"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col(total) == 0).alias("_z")
    )
    r = F.coalesce(F.col("r"), F.lit(0.0))
    row = daily.agg(
        ratio(F.sum("_z"), F.sum("_n")).alias("sparsity"), ratio(F.sum("_t"), F.sum("_n")).alias("signal"),
        ratio(F.stddev_pop("_t"), F.avg("_t")).alias("cv"), safe_corr("_o", "_t").alias("r"),
    )
    return row.withColumns({
        "score_sparsity": F.greatest(F.lit(0.0), 100 - F.col("sparsity") * 150),
        "score_signal": F.least(F.lit(100.0), F.col("signal") * 50),
        "score_corr": F.when(r > 0, F.abs(r) * 100).otherwise(50.0),
    }).withColumn("score", F.col("score_sparsity") * 0.4 + F.col("score_signal") * 0.3 + F.col("score_corr") * 0.3)


def viability_b(panel: DataFrame, zone: str, date: str, features: Sequence[str], outcome: str) -> DataFrame:
    """Mean feature score plus a bonus for correlated features, at most 100.

    Three passes over the panel whatever the number of features: cells, days and
    zones.
    """
    others = [f for f in features if f != outcome]
    cells = one_row(panel.agg(
        *[(1 - F.count_if(F.col(f) != 0) / F.count(F.lit(1))).alias(f"sparse_{f}") for f in features],
        *[F.coalesce(F.avg(F.when(F.col(f) > 0, F.col(f))), F.lit(0.0)).alias(f"signal_{f}") for f in features],
        *[F.coalesce(F.abs(safe_corr(outcome, f)), F.lit(0.0)).alias(f"r_{f}") for f in others],
    ))
    sums = [F.sum(f).alias(f) for f in features]
    busy = {f: F.when(F.col(f) > 0, F.col(f)) for f in features}
    days = one_row(panel.groupBy(date).agg(*sums).agg(
        *[F.coalesce(ratio(F.stddev_pop(x), F.avg(x)), F.lit(0.0)).alias(f) for f, x in busy.items()]
    ))
    zones = panel.groupBy(zone).agg(*sums).agg(F.count(F.lit(1)).alias("_n"), *[F.count(x).alias(f) for f, x in busy.items()])
    score = F.lit(0.0)
    for f in features:
        score = score + (
            F.greatest(F.lit(0.0), 100 - cells[f"sparse_{f}"] * 150) * 0.25 + F.least(F.lit(100.0), cells[f"signal_{f}"] * 1000) * 0.35
            + F.greatest(F.lit(0.0), 100 - F.abs(days[f] - 0.5) * 50) * 0.2 + F.col(f) / F.col("_n") * 100 * 0.2
        )
    bonus = F.lit(0.0)
    for f in others:
        bonus = bonus + F.when(cells[f"r_{f}"] > 0.1, cells[f"r_{f}"] * 10).otherwise(0.0)
    out = zones.select((score / len(features)).alias("mean_score"), bonus.alias("bonus"))
    return out.withColumn("score", F.least(F.col("mean_score") + F.col("bonus"), F.lit(100.0)))


def cross_series_classes(pairs: DataFrame, zone: str, x: str, y: str) -> DataFrame:
    """Class of each zone's correlation and the share of each sign."""
    r = grouped_correlation(pairs, [zone], x, y)
    label = F.when(F.col("r") < -0.3, "Eficaz").when(F.col("r") > 0.3, "Ineficaz").otherwise("Neutro")
    return r.filter(F.col("r").isNotNull()).withColumn("class", label)


def cross_series_summary(classes: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return classes.agg(
        n.alias("zones"), (F.count_if(F.col("r") > 0) * 100.0 / n).alias("pct_positive"),
        (F.count_if(F.col("r") < 0) * 100.0 / n).alias("pct_negative"),
        (F.count_if(F.abs(F.col("r")) > 0.3) * 100.0 / n).alias("pct_strong"),
    )


# Bands of the dose table.
DOSE_STEPS = [(10.0, "ALTO"), (5.0, "MEDIO"), (0.0, "BAIXO")]


def dose_bands(pairs: DataFrame, zone: str, period: str, dose: str, level: str) -> DataFrame:
    """Dose band of each period and the change band of the level that follows."""
    d = next_deltas(pairs, zone, period, [level])
    change = F.when(F.col(level) > 0, (F.col("next_" + level) - F.col(level)) / F.col(level) * 100).otherwise(0.0)
    d = d.withColumn("change", change)
    return d.withColumn("band", ladder(F.col(dose), DOSE_STEPS, "NULO")).withColumn(
        "change_band",
        F.when(F.col("change") < -15, "fell_15").when(F.col("change") < 0, "fell").when(F.col("change") < 15, "rose").otherwise("rose_15"),
    )


def dose_response(bands: DataFrame, dose: str) -> DataFrame:
    n = F.count(F.lit(1))
    return bands.groupBy("band").agg(
        n.alias("n"), F.avg(dose).alias("mean_dose"), (F.count_if(F.col("change") < -15) * 100.0 / n).alias("pct_fell_15"),
        (F.count_if(F.col("change") < 0) * 100.0 / n).alias("pct_fell"), F.avg(F.when(F.col("change") < 0, F.col("change"))).alias("mean_fall"),
    )


def coverage_ratio(actions: DataFrame, outcomes: DataFrame, zone: str, action: str, outcome: str) -> DataFrame:
    """Actions per outcome on zones present in both, from counts per zone."""
    a = actions.groupBy(zone).agg(F.sum(action).alias("actions"))
    o = outcomes.groupBy(zone).agg(F.sum(outcome).alias("outcomes"))
    return a.join(o, zone).withColumn("ratio", ratio(F.col("actions"), F.col("outcomes")))
