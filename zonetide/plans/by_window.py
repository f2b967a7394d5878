"""W*: window functions over dense panels and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.functions import dates
from zonetide.functions.ladders import ALERT_STEPS, ladder
from zonetide.operators import aggregates as agg
from zonetide.operators import ranking, study, windows
from zonetide.operators.joins import as_of
from zonetide.operators.panel import bounds
from zonetide.plans.registry import query
from zonetide.plans.views import with_sql

_ZD = "OVER (PARTITION BY zone ORDER BY date"


@query("w1_lags", with_sql("panel", "SELECT zone, date, " + ", ".join(f"CAST(lag({c}, {k}, 0) {_ZD}) AS DOUBLE) AS {c}_lag{k}" for c in ("n", "click") for k in (1, 7, 30)) + " FROM panel", "click_lag1 click_lag7 click_lag30"))
def _(v):
    p = v.panel().select("zone", "date", "n", "click")
    return windows.lags(p, "zone", "date", ["n", "click"], (1, 7, 30)).drop("n", "click")


_MA = " ".join(f"{c}_ma{k}" for c in ("n", "click") for k in (7, 30))


@query("w2_trailing_mean", with_sql("panel", "SELECT zone, date, " + ", ".join(f"avg({c}) {_ZD} ROWS {k - 1} PRECEDING) AS {c}_ma{k}" for c in ("n", "click") for k in (7, 30)) + " FROM panel", _MA))
def _(v):
    p = v.panel().select("zone", "date", "n", "click")
    return windows.trailing_means(p, "zone", "date", ["n", "click"], (7, 30)).drop("n", "click")


@query("w3_trailing_std", with_sql("panel", f"SELECT zone, date, coalesce(stddev_samp(n) {_ZD} ROWS 6 PRECEDING), 0) AS n_vol7 FROM panel", "n_vol7"))
def _(v):
    return windows.trailing_volatility(v.panel().select("zone", "date", "n"), "zone", "date", ["n"]).drop("n")


@query("w4_trailing_count_exclusive", with_sql("panel", f"SELECT zone, date, CAST(coalesce(sum(n) {_ZD} ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS trailing FROM panel"))
def _(v):
    return windows.trailing_count(v.panel(), "zone", "date", "n", 18).select("zone", "date", "trailing")


@query(
    "w4_trailing_count_sparse",
    with_sql("oe", "SELECT zone, date, n, CAST(sum(n) OVER (PARTITION BY zone ORDER BY date RANGE BETWEEN INTERVAL 179 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing FROM (SELECT zone, date, count(*) AS n FROM oe GROUP BY 1, 2)"),
)
def _(v):
    return windows.trailing_count(v.outcome_daily(), "zone", "date", "n", 180, inclusive=True)


@query(
    "w5_percent_rank_per_day",
    with_sql("panel", "SELECT zone, date, (rank() OVER (PARTITION BY date ORDER BY n) + (count(*) OVER (PARTITION BY date, n) - 1) / 2) / count(*) OVER (PARTITION BY date) AS pct FROM panel", "pct"),
)
def _(v):
    return windows.percent_rank_per_day(v.panel_table().select("zone", "date", "n"), "date", "n").drop("n")


@query(
    "w6_quartile_scale",
    with_sql(
        "panel",
        "SELECT p.zone, p.date, CASE WHEN q.p75 > q.p25 THEN least(greatest((click - q.p25) / (q.p75 - q.p25), 0), 1) ELSE click END AS scaled FROM panel p LEFT JOIN "
        "(SELECT date, quantile_cont(click, 0.25) AS p25, quantile_cont(click, 0.75) AS p75 FROM panel WHERE click > 0 GROUP BY date) q ON q.date = p.date",
        "scaled",
    ),
)
def _(v):
    return windows.quartile_scale_per_day(v.panel_table().select("zone", "date", "click"), "date", "click").drop("click")


@query("w7_capped_rate", with_sql("panel", f"SELECT zone, date, least(1, coalesce(sum(n) {_ZD} ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING), 0) / 18) AS rate FROM panel", "rate"))
def _(v):
    t = windows.trailing_count(v.panel(), "zone", "date", "n", 18)
    return t.select("zone", "date", F.least(F.col("trailing") / 18, F.lit(1.0)).alias("rate"))


@query("w8_centred_mean", with_sql("panel", f"SELECT zone, date, avg(click) {_ZD} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM panel", "smooth"))
def _(v):
    return windows.centred_mean(v.panel(), "zone", "date", "click").select("zone", "date", "smooth")


@query("w9_label_changes", with_sql("newl", "SELECT zone, date, old_label, new_label FROM newl"))
def _(v):
    return windows.label_changes(v.label_set(), "zone", "date", "labels")


@query(
    "w9_lost_labels",
    with_sql(
        "lset",
        "SELECT zone, date, old[1] AS old_label, unnest(CASE WHEN len(labels) = 0 THEN [NULL] ELSE list_filter(labels, lambda x: NOT list_contains(old, x)) END) AS new_label FROM lch",
        extra="lcm AS (SELECT z.zone, d.date, coalesce(l.labels, []) AS labels FROM (SELECT DISTINCT zone FROM lset) z CROSS JOIN (SELECT DISTINCT date FROM lset) d LEFT JOIN lset l ON l.zone = z.zone AND l.date = d.date), "
        "lch AS (SELECT * FROM (SELECT zone, date, labels, lag(labels) OVER (PARTITION BY zone ORDER BY date) AS old FROM lcm) WHERE old IS NOT NULL AND old <> labels)",
    ),
)
def _(v):
    """A zone without a row at a snapshot has lost its labels."""
    whole = windows.complete_labels(v.label_set(), "zone", "date", "labels")
    return windows.label_changes(whole, "zone", "date", "labels")


@query(
    "w10_days_since_change",
    with_sql("cp", f"SELECT zone, date, CAST(coalesce(least(date - max(CASE WHEN changed = 1 THEN date END) {_ZD} ROWS UNBOUNDED PRECEDING), 365), 365) AS INTEGER) AS days_since FROM cp"),
)
def _(v):
    return windows.days_since_change(v.change_panel(), "zone", "date", "changed").select("zone", "date", "days_since")


@query("w11_conflict_risk", with_sql("panel lset", "SELECT p.zone, p.date, least(len(l.labels) / 3, 1) AS risk FROM panel p ASOF LEFT JOIN lset l ON l.zone = p.zone AND l.date <= p.date", "risk"))
def _(v):
    rows = as_of(v.panel().select("zone", "date"), v.label_set(), "zone", "date", "labels")
    return rows.select("zone", "date", windows.label_risk(F.col("labels")).alias("risk"))


@query(
    "w11_unlabelled_zone",
    with_sql("panel lset", "SELECT p.zone, p.date, CASE WHEN l.labels IS NULL THEN 0 WHEN len(l.labels) > 3 THEN 1 ELSE len(l.labels) / 3 END AS risk FROM panel p ASOF LEFT JOIN (SELECT * FROM lset WHERE zone % 3 <> 0 AND date > DATE '2024-01-10') l ON l.zone = p.zone AND l.date <= p.date", "risk"),
)
def _(v):
    """Zones that have no label yet, or never one, carry no risk."""
    labels = v.label_set().filter((F.col("zone") % 3 != 0) & (F.col("date") > F.lit("2024-01-10").cast("date")))
    rows = as_of(v.panel().select("zone", "date"), labels, "zone", "date", "labels")
    return rows.select("zone", "date", windows.label_risk(F.col("labels")).alias("risk"))


@query("w12_change_volatility", with_sql("cp", f"SELECT zone, date, least(coalesce(sum(changed) {_ZD} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) / 30, 1) AS change_volatility FROM cp", "change_volatility"))
def _(v):
    return windows.change_volatility(v.change_panel(), "zone", "date", "changed").select("zone", "date", "change_volatility")


@query(
    "w13_next_deltas",
    with_sql("pm", "SELECT * FROM (SELECT zone, month, x, y, lead(month) OVER w AS next_month, lead(x) OVER w AS next_x, lead(y) OVER w AS next_y, lead(x) OVER w - x AS d_x, lead(y) OVER w - y AS d_y FROM pm WINDOW w AS (PARTITION BY zone ORDER BY month)) WHERE next_month IS NOT NULL"),
)
def _(v):
    return windows.next_deltas(v.pairs_m(), "zone", "month", ["x", "y"])


_DIFF = "(SELECT zone, date, " + ", ".join(f"CAST({c} - lag({c}) {_ZD}) AS DOUBLE) AS d_{c}" for c in ("n", "click", "view", "purchase")) + " FROM panel)"


@query(
    "w14_delta_variance",
    with_sql("panel", "SELECT feature, variance FROM (" + " UNION ALL ".join(f"SELECT 'd_{c}' AS feature, var_samp(d_{c}) AS variance FROM {_DIFF}" for c in ("n", "click", "view", "purchase")) + ") ORDER BY variance DESC, feature LIMIT 5", "variance"),
)
def _(v):
    cols = ["n", "click", "view", "purchase"]
    d = windows.first_differences(v.panel(), "zone", "date", cols)
    row = d.agg(*[F.var_samp("d_" + c).alias("d_" + c) for c in cols])
    return ranking.top_k(row.unpivot([], ["d_" + c for c in cols], "feature", "variance"), [F.col("variance").desc(), F.col("feature")], 5)


@query("w14_delta_correlation", with_sql("panel", f"SELECT 'd_n' AS a, 'd_click' AS b, corr(d_n, d_click) AS r FROM {_DIFF} UNION ALL SELECT 'd_n', 'd_view', corr(d_n, d_view) FROM {_DIFF} UNION ALL SELECT 'd_click', 'd_view', corr(d_click, d_view) FROM {_DIFF}", "r"))
def _(v):
    d = windows.first_differences(v.panel(), "zone", "date", ["n", "click", "view"])
    return study.correlation_matrix(d, ["d_n", "d_click", "d_view"])


@query("w15_first_last_trend", with_sql("om", "SELECT zone, (arg_max(y, month) - arg_min(y, month)) / greatest(arg_min(y, month), 1) AS trend FROM om GROUP BY zone", "trend"))
def _(v):
    return windows.first_last_trend(v.outcome_m(), "zone", "month", "y")


def _index(v, part):
    parts = {"month": F.month("date"), "weekday": F.weekday("date"), "hour": F.col("hour")}
    return agg.seasonal_index(v.event().select("zone", parts[part].alias(part)), ["zone"], part)


_IDX = "idx AS (SELECT zone, hour, count(*) AS n, count(*) / avg(count(*)) OVER (PARTITION BY zone) AS index FROM ev GROUP BY 1, 2), pk AS (SELECT zone, hour, n, index FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY index DESC, hour) AS rn FROM idx) WHERE rn = 1) "


@query("w16_peaks", with_sql("ev", "SELECT zone, hour, n, index FROM pk", "index", extra=_IDX))
def _(v):
    return agg.peaks(_index(v, "hour"), ["zone"], "hour").select("zone", "hour", "n", "index")


@query("w17_peak_frequency", with_sql("ev", "SELECT hour, count(*) AS zones, count(*) * 100 / sum(count(*)) OVER () AS pct FROM pk GROUP BY hour", "pct", extra=_IDX))
def _(v):
    return agg.peak_frequency(agg.peaks(_index(v, "hour"), ["zone"], "hour"), "hour")


@query("w18_dense_ids", "SELECT c_name AS name, row_number() OVER (ORDER BY c_name) - 1 AS id FROM (SELECT DISTINCT c_name FROM customer)")
def _(v):
    return ranking.dense_ids(v.table("customer").select(F.col("c_name").alias("name")), "name")


@query("w19_equal_periods", with_sql("oe", "SELECT zone, CAST((date - (SELECT min(date) FROM oe)) // 30 AS BIGINT) AS period, count(*) AS n FROM oe GROUP BY 1, 2"))
def _(v):
    e = v.outcome_daily()
    first, _ = bounds(v.table("orders").filter("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("date")))
    return e.groupBy("zone", dates.period_index("date", first, 30).cast("bigint").alias("period")).agg(F.sum("n").alias("n"))


_DOSE = (
    "(SELECT zone, month, x, y, CASE WHEN x > 10 THEN 'ALTO' WHEN x > 5 THEN 'MEDIO' WHEN x > 0 THEN 'BAIXO' ELSE 'NULO' END AS band, change, "
    "CASE WHEN change < -15 THEN 'fell_15' WHEN change < 0 THEN 'fell' WHEN change < 15 THEN 'rose' ELSE 'rose_15' END AS change_band FROM "
    "(SELECT *, (ny - y) * 100.0 / y AS change FROM (SELECT *, lead(y) OVER (PARTITION BY zone ORDER BY month) AS ny FROM pm) WHERE ny IS NOT NULL))"
)


@query("w20_change_bands", with_sql("pm", f"SELECT band, change_band, count(*) AS n FROM {_DOSE} GROUP BY 1, 2"))
def _(v):
    bands = study.dose_bands(v.pairs_m(), "zone", "month", "x", "y")
    return bands.groupBy("band", "change_band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w21_previous_window",
    with_sql("ev", "SELECT zone, count(*) FILTER (date >= DATE '2024-01-16') AS current, count(*) FILTER (date < DATE '2024-01-16') AS previous FROM ev WHERE date BETWEEN DATE '2024-01-02' AND DATE '2024-01-30' GROUP BY zone"),
)
def _(v):
    return windows.window_compare(v.event(), "zone", "date", F.lit("2024-01-16").cast("date"), F.lit("2024-01-30").cast("date"))


@query(
    "w22_fill_with_mean",
    with_sql("zd", "SELECT zone, coalesce(b, (SELECT avg(b) FROM (SELECT zone, avg(s_acctbal) AS b FROM zd LEFT JOIN supplier ON s_nationkey = zone AND s_acctbal > 8000 GROUP BY zone))) AS filled FROM (SELECT zone, avg(s_acctbal) AS b FROM zd LEFT JOIN supplier ON s_nationkey = zone AND s_acctbal > 8000 GROUP BY zone)", "filled"),
)
def _(v):
    known = v.table("supplier").filter("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("zone")).agg(F.avg("s_acctbal").alias("b"))
    return windows.fill_with_mean(v.zone_dim().select("zone").join(known, "zone", "left"), "b", "filled").select("zone", "filled")


def _classes(v):
    _, last = bounds(v.event().select("date"))
    return windows.minmax_classes(v.panel(), "zone", "date", "n", 15, lambda s: ladder(s, ALERT_STEPS, "BAIXO"), last)


_LEVEL = "(SELECT zone, avg(n) AS level FROM panel WHERE date > (SELECT max(date) FROM panel) - 15 GROUP BY zone)"


@query(
    "w23_recent_class_shares",
    with_sql(
        "panel",
        "SELECT class, count(*) AS zones, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM (SELECT CASE WHEN s > 0.8 THEN 'CRITICO' WHEN s > 0.5 THEN 'ALTO' WHEN s > 0.2 THEN 'MEDIO' ELSE 'BAIXO' END AS class FROM "
        f"(SELECT (level - min(level) OVER ()) / (max(level) OVER () - min(level) OVER ()) AS s FROM {_LEVEL})) GROUP BY class",
        "pct",
    ),
)
def _(v):
    c = _classes(v)
    counts = c.groupBy("class").agg(F.count(F.lit(1)).alias("zones"))
    return agg.share_within(counts, [], "zones", "pct").withColumn("pct", F.col("pct") * 100)


@query(
    "w23_recent_classes",
    with_sql("panel", f"SELECT zone, level, (level - min(level) OVER ()) / (max(level) OVER () - min(level) OVER ()) AS scaled FROM {_LEVEL}", "level scaled"),
)
def _(v):
    return _classes(v).drop("class")
