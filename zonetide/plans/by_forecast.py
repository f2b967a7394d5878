"""P28 and ST20-ST28: forecasts, baselines and validation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.operators import forecast, windows
from zonetide.plans.registry import query
from zonetide.plans.views import with_sql

_FACTOR = "(SELECT avg((CASE WHEN d < 120 THEN 1.0 ELSE 1.0 - 0.003 * (d - 120) END) * (1 + 0.2 * sin(2 * pi() * d / 30))) FROM (SELECT unnest(range(210)) AS d))"


@query(
    "p28_blended_forecast",
    with_sql(
        "cp panel",
        f"SELECT zone, least(greatest(least(greatest(mean * 0.8 + model * 0.3 * 0.2, 0), top) * {_FACTOR} * (1 + 0.3 * chg), 0), top) AS forecast, chg AS change, sd / (peak + 1e-6) AS volatility FROM "
        "(SELECT c.zone, avg(c.n) AS mean, max(c.n) AS peak, stddev_pop(c.n) AS sd, max(p.click) / 100 AS model, least(sum(changed) / 3, 1) AS chg, (SELECT max(n) FROM panel) * 1.2 AS top FROM cp c JOIN panel p ON p.zone = c.zone AND p.date = c.date GROUP BY c.zone)",
        "forecast change volatility",
    ),
)
def _(v):
    # the model's output and the chance of a label change come with the history
    days = v.panel().join(v.change_panel().select("zone", "date", "changed"), ["zone", "date"])
    zone = Window.partitionBy("zone")
    h = days.select("zone", "n", (F.max("click").over(zone) / 100).alias("model"), (F.sum("changed").over(zone) / 3).alias("change"))
    return forecast.blended_forecast(h, "zone", "n", "model", "change")


_PRED = "pp AS (SELECT zone, period, level, avg(level) OVER (PARTITION BY zone ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS guess, lag(level) OVER (PARTITION BY zone ORDER BY period) AS base FROM per), sg AS (SELECT zone, period, CASE WHEN abs(level - base) <= 1 THEN 0 ELSE sign(level - base) END AS a, CASE WHEN abs(guess - base) <= 1 THEN 0 ELSE sign(guess - base) END AS p FROM pp WHERE base IS NOT NULL) "


def _guess(v):
    """Level per five-day period with the mean of all periods before it."""
    past = Window.partitionBy("zone").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return v.periods().withColumn("guess", F.avg("level").over(past))


def _signs(v):
    return forecast.directions(_guess(v), "zone", "period", "level", "guess", 1.0)


@query("st20_direction_accuracy", with_sql("per", "SELECT count(*) AS n, avg(CASE WHEN a = p THEN 100.0 ELSE 0 END) AS accuracy, corr(a, p) AS r FROM sg", "accuracy r", extra=_PRED))
def _(v):
    return forecast.direction_accuracy(_signs(v))


@query("st20_accuracy_per_class", with_sql("per", "SELECT CAST(p AS INTEGER) AS predicted_sign, count(*) AS n, avg(CASE WHEN a = p THEN 100.0 ELSE 0 END) AS accuracy FROM sg GROUP BY p", "accuracy", extra=_PRED))
def _(v):
    return forecast.direction_accuracy(_signs(v), ["predicted_sign"]).drop("r")


@query("st20_accuracy_per_zone", with_sql("per", "SELECT zone, count(*) AS n, avg(CASE WHEN a = p THEN 100.0 ELSE 0 END) AS accuracy FROM sg GROUP BY zone", "accuracy", extra=_PRED))
def _(v):
    return forecast.direction_accuracy(_signs(v), ["zone"]).drop("r")


@query(
    "st20_confusion",
    with_sql("per", "SELECT CAST(a AS INTEGER) AS actual_sign, count(*) FILTER (p = -1) AS down, count(*) FILTER (p = 0) AS same, count(*) FILTER (p = 1) AS up FROM sg GROUP BY a", extra=_PRED),
)
def _(v):
    return forecast.confusion(_signs(v))


_EMA = "rec AS (WITH RECURSIVE e AS (SELECT zone, period, CAST(level AS DOUBLE) AS s FROM per WHERE period = 0 UNION ALL SELECT p.zone, p.period, e.s * 0.7 + p.level * 0.3 FROM e JOIN per p ON p.zone = e.zone AND p.period = e.period + 1) SELECT * FROM e) "


@query("st21_ema_baseline", with_sql("per", "SELECT p.zone, p.period, r.s AS ema FROM per p LEFT JOIN rec r ON r.zone = p.zone AND r.period = p.period - 1", "ema", extra=_EMA))
def _(v):
    return forecast.ema_baseline(v.periods(), "zone", "period", "level", 0.3).select("zone", "period", "ema")


@query(
    "st21_linear_baseline",
    with_sql("per", "SELECT a.zone, a.period, (SELECT CASE WHEN count(*) = 0 THEN NULL WHEN count(*) = 1 THEN NULL ELSE regr_intercept(b.level, b.period) + regr_slope(b.level, b.period) * a.period END FROM per b WHERE b.zone = a.zone AND b.period < a.period) AS linear FROM per a", "linear"),
)
def _(v):
    return forecast.linear_baseline(v.periods(), "zone", "period", "level").select("zone", "period", "linear")


@query("st21_always_stable", with_sql("per", "SELECT count(*) AS n, avg(CASE WHEN a = 0 THEN 100.0 ELSE 0 END) AS accuracy FROM sg", "accuracy", extra=_PRED))
def _(v):
    signs = _signs(v).withColumn("predicted_sign", F.lit(0))
    return forecast.direction_accuracy(signs).drop("r")


_BL = (
    "be AS (SELECT p.zone, p.period, p.level, lag(p.level) OVER (PARTITION BY p.zone ORDER BY p.period) AS base, r.s AS ema, (SELECT regr_intercept(b.level, b.period) + regr_slope(b.level, b.period) * p.period FROM per b WHERE b.zone = p.zone AND b.period < p.period) AS linear "
    "FROM per p LEFT JOIN rec r ON r.zone = p.zone AND r.period = p.period - 1), "
    "bs AS (SELECT CASE WHEN abs(level - base) <= 1.03717 THEN 0 ELSE sign(level - base) END AS a, CASE WHEN abs(ema - base) <= 1.03717 THEN 0 ELSE sign(ema - base) END AS e, CASE WHEN abs(linear - base) <= 1.03717 THEN 0 ELSE sign(linear - base) END AS l FROM be WHERE period >= 2) "
)


@query(
    "st21_baseline_accuracies",
    with_sql("per", "SELECT 'ema' AS baseline, count(*) AS n, avg(CASE WHEN a = e THEN 100.0 ELSE 0 END) AS accuracy FROM bs UNION ALL SELECT 'linear', count(*), avg(CASE WHEN a = l THEN 100.0 ELSE 0 END) FROM bs UNION ALL SELECT 'stable', count(*), avg(CASE WHEN a = 0 THEN 100.0 ELSE 0 END) FROM bs", "accuracy", extra=_EMA + ", " + _BL),
)
def _(v):
    rows = forecast.linear_baseline(forecast.ema_baseline(v.periods(), "zone", "period", "level", 0.3), "zone", "period", "level")
    rows = rows.withColumn("stable", F.lag("level").over(_order()))
    out = None
    for name in ("ema", "linear", "stable"):
        signs = forecast.directions(rows, "zone", "period", "level", name, 1.03717).filter("period >= 2")
        one = forecast.direction_accuracy(signs).select(F.lit(name).alias("baseline"), "n", "accuracy")
        out = one if out is None else out.unionByName(one)
    return out


def _order():
    return Window.partitionBy("zone").orderBy("period")


_ERR = "count(*) AS n, avg((predicted - actual) * (predicted - actual)) AS mse, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse"


@query("st22_errors", with_sql("pred", f"SELECT {_ERR} FROM pred", "mse mae rmse"))
def _(v):
    return forecast.errors(v.prediction(), "actual", "predicted")


@query("st22_errors_per_zone", with_sql("per", "SELECT zone, count(*) AS n, avg((guess - level) * (guess - level)) AS mse, avg(abs(guess - level)) AS mae, sqrt(avg((guess - level) * (guess - level))) AS rmse FROM (SELECT *, avg(level) OVER (PARTITION BY zone ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS guess FROM per) WHERE guess IS NOT NULL GROUP BY zone", "mse mae rmse"))
def _(v):
    return forecast.errors(_guess(v).filter("guess IS NOT NULL"), "level", "guess", ["zone"])


_NEXT = ", ".join(f"lag({c}) OVER (PARTITION BY zone ORDER BY date) AS p_{c}" for c in ("n", "click", "view"))


@query(
    "st22_errors_per_feature",
    with_sql(
        "panel",
        "SELECT feature, count(*) AS n, avg(pow(p - a, 2)) AS mse, avg(abs(p - a)) AS mae, sqrt(avg(pow(p - a, 2))) AS rmse FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS a, p_{c} AS p FROM (SELECT *, {_NEXT} FROM panel)" for c in ("n", "click", "view")) + ") WHERE p IS NOT NULL GROUP BY feature",
        "mse mae rmse",
    ),
)
def _(v):
    # yesterday's value as the forecast of each feature
    w = Window.partitionBy("zone").orderBy("date")
    names = ("n", "click", "view")
    rows = v.panel().withColumns({f"p_{c}": F.lag(c).over(w) for c in names})
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("actual"), F.col(f"p_{c}").cast("double").alias("predicted")) for c in names
    ])
    long = rows.select(F.explode(cells).alias("c")).select("c.*").filter("predicted IS NOT NULL")
    return forecast.errors(long, "actual", "predicted", ["feature"])


@query(
    "st22_error_difference",
    with_sql("per", "SELECT avg(abs(guess - level)) - avg(abs(base - level)) AS mae_difference, sqrt(avg(pow(guess - level, 2))) - sqrt(avg(pow(base - level, 2))) AS rmse_difference FROM (SELECT *, avg(level) OVER (PARTITION BY zone ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS guess, lag(level) OVER (PARTITION BY zone ORDER BY period) AS base FROM per) WHERE guess IS NOT NULL", "mae_difference rmse_difference"),
)
def _(v):
    rows = _guess(v).withColumn("base", F.lag("level").over(_order())).filter("guess IS NOT NULL")
    a, b = F.col("guess") - F.col("level"), F.col("base") - F.col("level")
    return rows.agg(
        (F.avg(F.abs(a)) - F.avg(F.abs(b))).alias("mae_difference"), (F.sqrt(F.avg(a * a)) - F.sqrt(F.avg(b * b))).alias("rmse_difference")
    )


@query(
    "st23_alignment_gaps",
    with_sql("pm", "SELECT zone, month, y, x, CASE WHEN y > hi AND x = 0 THEN 'gap' ELSE 'surplus' END AS kind FROM (SELECT om.zone, om.month, om.y, coalesce(tm.x, 0) AS x, (SELECT quantile_cont(y, 0.75) FROM om) AS hi, (SELECT quantile_cont(y, 0.25) FROM om) AS lo, "
             "(SELECT quantile_cont(coalesce(tm.x, 0), 0.75) FROM om LEFT JOIN tm ON tm.zone = om.zone AND tm.month = om.month) AS much FROM om LEFT JOIN tm ON tm.zone = om.zone AND tm.month = om.month) WHERE (y > hi AND x = 0) OR (y < lo AND x > much)"),
)
def _(v):
    rows = v.outcome_m().join(v.treat_m(), ["zone", "month"], "left").na.fill(0, subset=["x"])
    return forecast.alignment_gaps(rows, "y", "x")


@query(
    "st23_fixed_cutoffs",
    with_sql("per", "SELECT zone, period, scaled, level AS actions, CASE WHEN scaled > 0.8 AND level < 5 THEN 'gap' ELSE 'surplus' END AS kind FROM (SELECT *, click / (SELECT max(click) FROM per) AS scaled FROM per) WHERE (scaled > 0.8 AND level < 5) OR (scaled < 0.3 AND level > 10)", "scaled"),
)
def _(v):
    p = v.periods()
    top = p.select(F.max("click")).scalar()
    rows = p.select("zone", "period", (F.col("click") / top).alias("scaled"), F.col("level").alias("actions"))
    return forecast.fixed_gaps(rows, "scaled", "actions")


@query(
    "st25_totals_check",
    with_sql("pred ev", "SELECT predicted, observed, without, predicted - observed AS predicted_minus_observed, without - observed AS without_minus_observed FROM (SELECT (SELECT sum(predicted) FROM pred) AS predicted, (SELECT count(*) / 10.0 FROM ev WHERE date >= DATE '2024-01-21') AS observed, (SELECT count(*) / 10.0 FROM ev WHERE date >= DATE '2024-01-21' AND kind <> 'error') AS without)", "predicted observed without predicted_minus_observed without_minus_observed"),
)
def _(v):
    seen = v.event().filter(F.col("date") >= F.lit("2024-01-21").cast("date")).groupBy("zone").agg(
        (F.count(F.lit(1)) / 10.0).alias("observed"), (F.count_if(F.col("kind") != "error") / 10.0).alias("without")
    )
    return forecast.totals_check(v.prediction().join(seen, "zone", "left").na.fill(0), "predicted", "observed", "without")


_CLS = "CASE WHEN {c} > (SELECT quantile_cont({c}, 0.9) FROM {t}) THEN 'CRITICO' WHEN {c} > (SELECT quantile_cont({c}, 0.75) FROM {t}) THEN 'ALTO' WHEN {c} > (SELECT quantile_cont({c}, 0.5) FROM {t}) THEN 'MEDIO' ELSE 'BAIXO' END"


@query("st26_quantile_classes", "SELECT c_custkey, " + _CLS.format(c="c_acctbal", t="customer") + " AS class FROM customer")
def _(v):
    return forecast.quantile_classes(v.table("customer").select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal")


@query(
    "st27_critical_override",
    with_sql("dz", f"SELECT zone, date, click >= (SELECT quantile_cont(click, 0.9) FROM dz) * 1.15 AS critical, CASE WHEN click >= (SELECT quantile_cont(click, 0.9) FROM dz) * 1.15 THEN 'CRITICO' ELSE {_CLS.format(c='click', t='dz')} END AS class FROM dz"),
)
def _(v):
    return forecast.quantile_classes(v.daily_zone().select("zone", "date", "click"), "click", override=(0.9, 1.15)).drop("click")


@query(
    "st28_weighted_loss",
    with_sql(
        "cp",
        "SELECT zone, avg((1 + 2 * changed + 0.5 * (1 - days / 365)) * pow(coalesce(guess, 0) - n, 2)) AS loss FROM (SELECT zone, n, changed, avg(n) OVER (PARTITION BY zone ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS guess, "
        "coalesce(least(date - max(CASE WHEN changed = 1 THEN date END) OVER (PARTITION BY zone ORDER BY date ROWS UNBOUNDED PRECEDING), 365), 365) AS days FROM cp) GROUP BY zone",
        "loss",
    ),
)
def _(v):
    p = windows.days_since_change(v.change_panel(), "zone", "date", "changed")
    guess = F.avg("n").over(Window.partitionBy("zone").orderBy("date").rowsBetween(-7, -1))
    rows = p.withColumn("guess", F.coalesce(guess, F.lit(0.0)))
    return forecast.weighted_loss(rows, "n", "guess", "changed", "days_since").groupBy("zone").agg(F.avg("loss").alias("loss"))
