"""ST1-ST19, ST24, ST29: correlation, effect and trend studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.functions import dates
from zonetide.functions.stats import safe_corr
from zonetide.operators import aggregates as agg
from zonetide.operators import study
from zonetide.operators.ranking import top_k
from zonetide.plans.registry import query
from zonetide.plans.views import with_sql


@query(
    "st1_correlation_matrix",
    with_sql("panel", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM panel" for a, b in (("n", "click"), ("n", "view"), ("n", "purchase"), ("click", "view"), ("click", "purchase"), ("view", "purchase"))), "r"),
)
def _(v):
    return study.correlation_matrix(v.panel(), ["n", "click", "view", "purchase"])


# r where it is defined: at least two distinct values on both sides
_CORR = "CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-12 THEN corr(x, y) END"


@query("st2_correlation_per_zone", with_sql("pm", f"SELECT zone, count(*) AS n, {_CORR} AS r FROM pm GROUP BY zone", "r"))
def _(v):
    return study.grouped_correlation(v.pairs_m(), ["zone"], "x", "y")


# Independent form of the Student-t tail for the check: the density summed by
# Simpson's rule on the angle theta, t = sqrt(df) tan(theta).
def _p(t: str, df: str) -> str:
    """Two-sided p: 1 - 2 c * integral of cos(u)^(df - 1) over [0, atan(|t| / sqrt(df))]."""
    n = 400
    theta = f"atan(abs({t}) / sqrt({df}))"
    simpson = (
        f"(list_sum(list_transform(range({n} + 1), lambda k: (CASE WHEN k = 0 OR k = {n} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos({theta} * k / {n}), {df} - 1))) * {theta} / {n} / 3)"
    )
    return f"greatest(1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {simpson}, 0)"


_R = f"(SELECT zone, count(*) AS n, {_CORR} AS r FROM pm GROUP BY zone)"


@query("st3_correlation_test", with_sql("pm", f"SELECT zone, n, r, CASE WHEN n > 2 AND r IS NOT NULL THEN CASE WHEN abs(r) > 1 - 1e-12 THEN 0 ELSE {_p('t', '(n - 2)')} END END AS p FROM (SELECT *, r * sqrt(greatest(n - 2, 0)) / sqrt(greatest(1 - r * r, 1e-300)) AS t FROM {_R})", "r p"))
def _(v):
    return study.correlation_test(v.pairs_m(), ["zone"], "x", "y")


_PAIRS = (("click", "view"), ("click", "purchase"), ("view", "purchase"))


@query(
    "st3_flattened_panel_test",
    with_sql(
        "panel",
        f"SELECT a, b, n, r, {_p('(r * sqrt(n - 2) / sqrt(1 - r * r))', '(n - 2)')} AS p FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r FROM panel" for a, b in _PAIRS) + ")",
        "r p",
    ),
)
def _(v):
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in _PAIRS])
    return study.correlation_test(v.panel().select(F.explode(cells).alias("c")).select("c.*"), ["a", "b"], "x", "y")


_RANK = "(rank() OVER (PARTITION BY zone ORDER BY {c}) + (count(*) OVER (PARTITION BY zone, {c}) - 1) / 2)"


@query("st4_spearman", with_sql("pm", f"SELECT zone, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT zone, {_RANK.format(c='x')} AS rx, {_RANK.format(c='y')} AS ry FROM pm) GROUP BY zone", "rho"))
def _(v):
    return study.spearman(v.pairs_m(), ["zone"], "x", "y")


_SER = "sm AS (SELECT month, sum(x) AS x, sum(y) AS y, max(x) AS xmax FROM pm GROUP BY month)"


@query(
    "st5_lagged_correlation",
    with_sql("pm", " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({k} AS INTEGER) AS lag, corr({f}, ahead) AS r FROM (SELECT *, lead(y, {k}) OVER (ORDER BY month) AS ahead FROM sm)" for f in ("x", "xmax") for k in (0, 1, 3)), "r", extra=_SER),
)
def _(v):
    s = v.pairs_m().groupBy("month").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.max("x").alias("xmax"))
    out = study.lagged_correlation(s, "month", ["x", "xmax"], "y", [0, 1, 3])
    return out.orderBy(F.abs("r").desc(), "feature", "lag")


@query(
    "st6_autocorrelation",
    with_sql(
        "daily",
        "SELECT CAST(k.lag AS INTEGER) AS lag, sum(a.x * b.x) / any_value(a.ss) AS acf FROM (SELECT unnest(range(61)) AS lag) k JOIN c a ON TRUE JOIN c b ON b.t = a.t + k.lag GROUP BY k.lag",
        "acf",
        extra="c AS (SELECT row_number() OVER (ORDER BY date) AS t, n - avg(n) OVER () AS x, sum(n * n) OVER () - count(*) OVER () * avg(n) OVER () * avg(n) OVER () AS ss FROM daily)",
    ),
)
def _(v):
    return study.autocorrelation(v.daily().select("date", "n"), "date", "n", 60)


@query("st6_lag1_pearson", with_sql("daily", "SELECT corr(n, ahead) AS r FROM (SELECT n, lead(n) OVER (ORDER BY date) AS ahead FROM daily)", "r"))
def _(v):
    return study.lagged_correlation(v.daily(), "date", ["n"], "n", [1]).select("r")


def _season(v, part):
    parts = {"month": F.month("date"), "weekday": F.weekday("date")}
    return agg.seasonal_index(v.outcome_daily().select("zone", parts[part].alias(part), F.col("n").alias("w")), ["zone"], part, weight="w")


@query("st7_month_index", with_sql("oe", "SELECT zone, CAST(month(date) AS INTEGER) AS month, count(*) AS n, count(*) / avg(count(*)) OVER (PARTITION BY zone) AS index, count(*) / sum(count(*)) OVER (PARTITION BY zone) AS proportion FROM oe GROUP BY zone, month(date)", "index proportion"))
def _(v):
    return _season(v, "month")


@query("st7_weekday_index", with_sql("oe", "SELECT zone, CAST(isodow(date) - 1 AS INTEGER) AS weekday, count(*) AS n, count(*) / avg(count(*)) OVER (PARTITION BY zone) AS index, count(*) / sum(count(*)) OVER (PARTITION BY zone) AS proportion FROM oe GROUP BY zone, isodow(date)", "index proportion"))
def _(v):
    return _season(v, "weekday")


@query("st7_hour_index", with_sql("ev", "SELECT zone, hour, count(*) AS n, count(*) / avg(count(*)) OVER (PARTITION BY zone) AS index, count(*) / sum(count(*)) OVER (PARTITION BY zone) AS proportion FROM ev GROUP BY zone, hour", "index proportion"))
def _(v):
    return agg.seasonal_index(v.event().select("zone", "hour"), ["zone"], "hour")


_PROF = (
    "g AS (SELECT z.zone, m.mm, coalesce((SELECT avg(x) FROM tm WHERE tm.zone = z.zone AND month(tm.month) = m.mm), 0) AS x, coalesce((SELECT avg(y) FROM om WHERE om.zone = z.zone AND month(om.month) = m.mm), 0) AS y "
    "FROM (SELECT zone FROM tm INTERSECT SELECT zone FROM om) z CROSS JOIN (SELECT unnest(range(1, 13)) AS mm) m) "
)


@query(
    "st8_profile_comparison",
    with_sql("om tm", "SELECT zone, CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-12 THEN corr(x, y) END AS r, avg(abs(x - y)) AS mean_abs, CAST(max(abs(x - y)) AS DOUBLE) AS max_abs, count(*) FILTER (x <> 0) AS months_x, count(*) FILTER (y <> 0) AS months_y FROM g GROUP BY zone", "r mean_abs max_abs", extra=_PROF),
)
def _(v):
    """Mean of each calendar month over all years."""
    a = v.treat_m().groupBy("zone", F.month("month").alias("mm")).agg(F.avg("x").alias("n"))
    b = v.outcome_m().groupBy("zone", F.month("month").alias("mm")).agg(F.avg("y").alias("n"))
    return study.profile_comparison(a, b, "zone", "mm", "n")


@query(
    "st9_effectiveness",
    with_sql(
        "pm",
        f"SELECT zone, n, r, {_p('t', '(n - 2)')} AS p, ty AS total_outcome, tx AS total_treatment, my AS mean_outcome, mx AS mean_treatment, coalesce(-ty / nullif(tx, 0), 0) AS reduction, "
        "CASE WHEN r < -0.5 THEN 'MUITO ALTA' WHEN r < -0.2 THEN 'ALTA' WHEN r > 0.5 THEN 'INEFICAZ' WHEN r > 0.2 THEN 'BAIXA' ELSE 'NEUTRA' END AS class FROM "
        f"(SELECT *, r * sqrt(greatest(n - 2, 0)) / sqrt(greatest(1 - r * r, 1e-300)) AS t FROM (SELECT zone, count(*) AS n, {_CORR} AS r, CAST(sum(y) AS BIGINT) AS ty, CAST(sum(x) AS BIGINT) AS tx, avg(y) AS my, avg(x) AS mx FROM pm GROUP BY zone)) WHERE n >= 4 AND r IS NOT NULL",
        "r p mean_outcome mean_treatment reduction",
    ),
)
def _(v):
    return study.effectiveness(v.pairs_m(), ["zone"], "x", "y")


_BA = (
    "ba AS (SELECT t.zone, t.month, t.x, p.y AS prev, n.y AS next FROM (SELECT tm.*, q.c FROM tm JOIN (SELECT zone, quantile_cont(x, 0.75) AS c FROM tm GROUP BY zone) q ON q.zone = tm.zone) t JOIN om p ON p.zone = t.zone AND p.month = CAST(t.month - INTERVAL 1 MONTH AS DATE) "
    "JOIN om n ON n.zone = t.zone AND n.month = CAST(t.month + INTERVAL 1 MONTH AS DATE) WHERE t.x >= t.c) "
)


def _pairs(v):
    return study.before_after(v.treat_m(), v.outcome_m(), "zone", "month", "x", "y")


@query("st10_before_after", with_sql("om tm", "SELECT zone, count(*) AS pairs, avg(prev - next) AS mean_drop FROM ba GROUP BY zone", "mean_drop", extra=_BA))
def _(v):
    return study.before_after_mean(_pairs(v), "zone")


@query(
    "st11_paired_test",
    with_sql(
        "om tm",
        f"SELECT zone, pairs, mean_drop, median_drop, share_drop, t, CASE WHEN t IS NOT NULL THEN {_p('t', '(pairs - 1)')} END AS p FROM (SELECT zone, count(*) AS pairs, avg(prev - next) AS mean_drop, median(prev - next) AS median_drop, avg(CASE WHEN prev > next THEN 1.0 ELSE 0.0 END) AS share_drop, "
        "avg(prev - next) * sqrt(count(*)) / nullif(stddev_samp(prev - next), 0) AS t FROM ba GROUP BY zone HAVING count(*) >= 2)",
        "mean_drop median_drop share_drop t p",
        extra=_BA,
    ),
)
def _(v):
    return study.paired_test(_pairs(v), "zone")


_NX = "nx AS (SELECT * FROM (SELECT zone, month, x, y, lead(month) OVER w AS next_month, lead(x) OVER w AS next_x, lead(y) OVER w AS next_y FROM pm WINDOW w AS (PARTITION BY zone ORDER BY month)) WHERE next_month IS NOT NULL), ch AS (SELECT *, (next_x - x) * 100.0 / greatest(x, 1) AS treatment_pct, (next_y - y) * 100.0 / greatest(y, 1) AS outcome_pct FROM nx) "


@query(
    "st12_impact_patterns",
    with_sql("pm", "SELECT zone, month, next_month, outcome_pct, treatment_pct, CASE WHEN next_y < y THEN 'positive' ELSE 'negative' END AS kind FROM ch WHERE next_x > x AND (next_y < y OR (next_y > y AND outcome_pct > 30))", "outcome_pct treatment_pct", extra=_NX),
)
def _(v):
    return study.impact_patterns(v.pairs_m(), "zone", "month", "x", "y").select("zone", "month", "next_month", "outcome_pct", "treatment_pct", "kind")


@query(
    "st13_divergences",
    with_sql("pm", "SELECT zone, month, outcome_pct, treatment_pct FROM ch WHERE (treatment_pct > 30 AND outcome_pct < -30) OR (treatment_pct < -30 AND outcome_pct > 30)", "outcome_pct treatment_pct", extra=_NX),
)
def _(v):
    return study.divergences(v.pairs_m(), "zone", "month", "x", "y").select("zone", "month", "outcome_pct", "treatment_pct")


@query(
    "st14_trend_card",
    with_sql(
        "om",
        "SELECT zone, lm AS latest_month, latest, prev_month, prev_year_month, last_year, prev_year, total, CASE WHEN prev_month > 0 THEN (latest - prev_month) / prev_month END AS month_change, CASE WHEN prev_year_month > 0 THEN (latest - prev_year_month) / prev_year_month END AS year_month_change, "
        "CASE WHEN prev_year > 0 THEN (last_year - prev_year) / prev_year END AS year_change FROM (SELECT zone, any_value(lm) AS lm, CAST(sum(y) FILTER (month = lm) AS BIGINT) AS latest, CAST(coalesce(sum(y) FILTER (month = CAST(lm - INTERVAL 1 MONTH AS DATE)), 0) AS BIGINT) AS prev_month, "
        "CAST(sum(y) FILTER (month = CAST(lm - INTERVAL 12 MONTH AS DATE)) AS BIGINT) AS prev_year_month, CAST(sum(y) FILTER (year(month) = year(lm)) AS BIGINT) AS last_year, CAST(coalesce(sum(y) FILTER (year(month) = year(lm) - 1), 0) AS BIGINT) AS prev_year, CAST(sum(y) AS BIGINT) AS total "
        "FROM (SELECT *, max(month) OVER (PARTITION BY zone) AS lm FROM om) GROUP BY zone)",
        "month_change year_month_change year_change",
    ),
)
def _(v):
    return study.trend_card(v.outcome_m(), "zone", "month", "y")


@query(
    "st14_weekday_shift",
    with_sql(
        "oe",
        "SELECT zone, w AS weekday, shift FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY shift DESC, w) AS rn FROM (SELECT zone, w, round(rc / sum(rc) OVER (PARTITION BY zone) - bc / sum(bc) OVER (PARTITION BY zone), 12) AS shift FROM "
        "(SELECT zone, CAST(isodow(date) - 1 AS INTEGER) AS w, count(*) FILTER (year(date) >= 1999) AS rc, count(*) FILTER (year(date) < 1999) AS bc FROM oe GROUP BY 1, 2) QUALIFY sum(rc) OVER (PARTITION BY zone) > 0 AND sum(bc) OVER (PARTITION BY zone) > 0)) WHERE rn = 1",
        "shift",
    ),
)
def _(v):
    e = v.outcome_daily().withColumn("weekday", F.weekday("date"))
    return study.share_shift(e, "zone", "weekday", F.year("date") >= 1999, weight="n")


@query(
    "st14_hour_shift",
    with_sql(
        "ev",
        "SELECT zone, hour, shift FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY shift DESC, hour) AS rn FROM (SELECT zone, hour, round(rc / sum(rc) OVER (PARTITION BY zone) - bc / sum(bc) OVER (PARTITION BY zone), 12) AS shift FROM "
        "(SELECT zone, hour, count(*) FILTER (date >= DATE '2024-01-16') AS rc, count(*) FILTER (date < DATE '2024-01-16') AS bc FROM ev GROUP BY 1, 2) QUALIFY sum(rc) OVER (PARTITION BY zone) > 0 AND sum(bc) OVER (PARTITION BY zone) > 0)) WHERE rn = 1",
        "shift",
    ),
)
def _(v):
    return study.share_shift(v.event().select("zone", "hour", "date"), "zone", "hour", F.col("date") >= F.lit("2024-01-16").cast("date"))


_FIT = "ft AS (SELECT zone, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(x, y) AS r, sqrt(greatest(var_pop(y) - regr_slope(y, x) * covar_pop(x, y), 0) / var_pop(x) / (count(*) - 2)) AS stderr FROM pm GROUP BY zone) "


@query("st15_linear_fit", with_sql("pm", f"SELECT zone, n, r, slope, intercept, stderr, {_p('(slope / stderr)', '(n - 2)')} AS p FROM ft", "r slope intercept stderr p", extra=_FIT))
def _(v):
    return study.linear_fit(v.pairs_m(), ["zone"], "x", "y")


@query(
    "st16_dickey_fuller",
    with_sql(
        "om",
        "SELECT zone, n, t, t < -2.86 AS stationary FROM (SELECT zone, n, CASE WHEN vl > 1e-12 AND rest > 1e-12 * vd AND n > 2 THEN slope / sqrt(rest / vl / (n - 2)) END AS t FROM "
        "(SELECT zone, count(*) AS n, regr_slope(d, l) AS slope, var_pop(d) AS vd, var_pop(l) AS vl, var_pop(d) - regr_slope(d, l) * covar_pop(d, l) AS rest FROM "
        "(SELECT zone, lag(y) OVER w AS l, y - lag(y) OVER w AS d FROM om WINDOW w AS (PARTITION BY zone ORDER BY month)) WHERE l IS NOT NULL GROUP BY zone))",
        "t",
    ),
)
def _(v):
    return study.dickey_fuller(v.outcome_m(), "zone", "month", "y")


# Order 1 in SQL: the level and the difference without what the difference before tells of
# them, then a line through both.  The normal tail is a sum of Simpson.
_UNIT = (
    "st AS (SELECT zone, month, y, lag(y) OVER w AS l, y - lag(y) OVER w AS d FROM om WINDOW w AS (PARTITION BY zone ORDER BY month)), "
    "s1 AS (SELECT *, lag(d) OVER (PARTITION BY zone ORDER BY month) AS e FROM st), s2 AS (SELECT * FROM s1 WHERE e IS NOT NULL), "
    "cf AS (SELECT zone, count(*) AS n, regr_slope(l, e) AS bl, regr_intercept(l, e) AS al, regr_slope(d, e) AS bd, regr_intercept(d, e) AS ad FROM s2 GROUP BY zone HAVING var_pop(e) > 1e-12), "
    "rs AS (SELECT s2.zone, n, l - al - bl * e AS u, d - ad - bd * e AS v FROM s2 JOIN cf ON cf.zone = s2.zone), "
    "sl AS (SELECT zone, any_value(n) AS n, sum(u * v) / sum(u * u) AS b, sum(u * u) AS uu FROM rs GROUP BY zone HAVING sum(u * u) > 1e-9), "
    "tt AS (SELECT sl.zone, any_value(b) / sqrt(sum((v - b * u) * (v - b * u)) / (any_value(sl.n) - 3) / any_value(uu)) AS t FROM rs JOIN sl ON sl.zone = rs.zone WHERE sl.n > 3 GROUP BY sl.zone HAVING sum((v - b * u) * (v - b * u)) > 1e-12), "
    "zz AS (SELECT zone, t, CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END AS z FROM tt), "
    "pp AS (SELECT zone, t, CASE WHEN t < -18.83 THEN 0 WHEN t > 2.74 THEN 1 ELSE 0.5 + z / 1200 * list_sum(list_transform(range(0, 401), lambda i: exp(-pow(z * i / 400, 2) / 2) * (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END))) / sqrt(2 * pi()) END AS p FROM zz)"
)


@query(
    "st16_augmented_of_one_lag",
    with_sql("om", "SELECT z.zone, t, CASE WHEN t IS NOT NULL THEN 1 END AS lag, p, p < 0.05 AS stationary FROM (SELECT DISTINCT zone FROM om) z LEFT JOIN pp ON pp.zone = z.zone", "t p", extra=_UNIT),
)
def _(v):
    return study.augmented_dickey_fuller(v.outcome_m(), "zone", "month", "y", lag=1)


@query("st16_augmented_dickey_fuller")
def _(v):
    return study.augmented_dickey_fuller(v.outcome_m(), "zone", "month", "y")


@query(
    "st17_viability_a",
    with_sql(
        "panel",
        "SELECT *, score_sparsity * 0.4 + score_signal * 0.3 + score_corr * 0.3 AS score FROM (SELECT *, greatest(0, 100 - sparsity * 150) AS score_sparsity, least(100, signal * 50) AS score_signal, CASE WHEN r > 0 THEN abs(r) * 100 ELSE 50 END AS score_corr FROM "
        "(SELECT (SELECT count(*) FILTER (n = 0) / count(*) FROM panel) AS sparsity, (SELECT avg(n) FROM panel) AS signal, stddev_pop(t) / avg(t) AS cv, corr(c, t) AS r FROM (SELECT date, sum(n) AS t, sum(click) AS c FROM panel GROUP BY date)))",
        "sparsity signal cv r score_sparsity score_signal score_corr score",
    ),
)
def _(v):
    return study.viability_a(v.panel(), "date", "n", "click")


def _fs(f: str) -> str:
    return (
        f"(greatest(0, 100 - (SELECT 1 - count(*) FILTER ({f} <> 0) / count(*) FROM panel) * 150) * 0.25 + least(100, (SELECT avg({f}) FROM panel WHERE {f} > 0) * 1000) * 0.35 + "
        f"greatest(0, 100 - abs((SELECT stddev_pop(d) / avg(d) FROM (SELECT sum({f}) AS d FROM panel GROUP BY date) WHERE d > 0) - 0.5) * 50) * 0.2 + (SELECT count(*) FILTER (z > 0) / count(*) FROM (SELECT sum({f}) AS z FROM panel GROUP BY zone)) * 100 * 0.2)"
    )


def _bonus(f: str) -> str:
    return f"(SELECT CASE WHEN abs(corr(n, {f})) > 0.1 THEN abs(corr(n, {f})) * 10 ELSE 0 END FROM panel)"


@query(
    "st18_viability_b",
    with_sql("panel", f"SELECT mean_score, bonus, least(mean_score + bonus, 100) AS score FROM (SELECT ({_fs('n')} + {_fs('click')} + {_fs('purchase')}) / 3 AS mean_score, {_bonus('click')} + {_bonus('purchase')} AS bonus)", "mean_score bonus score"),
)
def _(v):
    return study.viability_b(v.panel_table(), "zone", "date", ["n", "click", "purchase"], "n")


_CL = f"(SELECT zone, n, r, CASE WHEN r < -0.3 THEN 'Eficaz' WHEN r > 0.3 THEN 'Ineficaz' ELSE 'Neutro' END AS class FROM (SELECT zone, count(*) AS n, {_CORR} AS r FROM pm GROUP BY zone) WHERE r IS NOT NULL)"


@query("st19_cross_series_class", with_sql("pm", f"SELECT * FROM {_CL}", "r"))
def _(v):
    return study.cross_series_classes(v.pairs_m(), "zone", "x", "y")


@query("st19_cross_series_summary", with_sql("pm", f"SELECT count(*) AS zones, count(*) FILTER (r > 0) * 100.0 / count(*) AS pct_positive, count(*) FILTER (r < 0) * 100.0 / count(*) AS pct_negative, count(*) FILTER (abs(r) > 0.3) * 100.0 / count(*) AS pct_strong FROM {_CL}", "pct_positive pct_negative pct_strong"))
def _(v):
    return study.cross_series_summary(study.cross_series_classes(v.pairs_m(), "zone", "x", "y"))


_DOSE = (
    "(SELECT zone, month, x, CASE WHEN x > 10 THEN 'ALTO' WHEN x > 5 THEN 'MEDIO' WHEN x > 0 THEN 'BAIXO' ELSE 'NULO' END AS band, change FROM "
    "(SELECT *, (ny - y) * 100.0 / y AS change FROM (SELECT *, lead(y) OVER (PARTITION BY zone ORDER BY month) AS ny FROM pm) WHERE ny IS NOT NULL))"
)


@query(
    "st24_dose_response",
    with_sql("pm", f"SELECT band, count(*) AS n, avg(x) AS mean_dose, count(*) FILTER (change < -15) * 100.0 / count(*) AS pct_fell_15, count(*) FILTER (change < 0) * 100.0 / count(*) AS pct_fell, avg(change) FILTER (change < 0) AS mean_fall FROM {_DOSE} GROUP BY band", "mean_dose pct_fell_15 pct_fell mean_fall"),
)
def _(v):
    return study.dose_response(study.dose_bands(v.pairs_m(), "zone", "month", "x", "y"), "x")


@query("st24_dose_correlation", with_sql("pm", f"SELECT corr(x, change) AS r FROM {_DOSE}", "r"))
def _(v):
    return study.dose_bands(v.pairs_m(), "zone", "month", "x", "y").agg(safe_corr("x", "change").alias("r"))


@query(
    "st29_coverage_ratio",
    with_sql("oe", "SELECT a.zone, actions, outcomes, actions / outcomes AS ratio FROM (SELECT s_nationkey AS zone, count(*) AS actions FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY 1) a JOIN (SELECT zone, count(*) AS outcomes FROM oe GROUP BY 1) o ON o.zone = a.zone ORDER BY ratio DESC, a.zone LIMIT 20", "ratio"),
)
def _(v):
    rows = study.coverage_ratio(v.treat_m(), v.outcome_m(), "zone", "x", "y")
    return top_k(rows, [F.col("ratio").desc(), F.col("zone")], 20)


@query("st29_iso_weeks", with_sql("oe", "SELECT strftime(date, '%G-W%V') AS week, count(*) AS n FROM oe GROUP BY 1"))
def _(v):
    return v.outcome_daily().groupBy(dates.iso_year_week("date").alias("week")).agg(F.sum("n").alias("n"))


