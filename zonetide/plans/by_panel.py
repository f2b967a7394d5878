"""T*: grids, panels and learning windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.operators import consolidate, graph, panel, spatial, windows
from zonetide.operators.panel import densify
from zonetide.operators.ranking import top_k
from zonetide.plans.registry import query
from zonetide.plans.views import with_sql

_ZD = "OVER (PARTITION BY zone ORDER BY date"


@query(
    "t1_complete_grid",
    with_sql("", "WITH oz AS (SELECT c_nationkey AS zone, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), "
             "c AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT min(date) AS lo, max(date) AS hi FROM oz)) "
             "SELECT z.zone, c.date, coalesce(oz.n, 0) AS n FROM (SELECT DISTINCT zone FROM oz) z CROSS JOIN c LEFT JOIN oz ON oz.zone = z.zone AND oz.date = c.date"),
)
def _(v):
    low, high = panel.bounds(v.table("orders").select(F.to_date("o_orderdate").alias("date")))
    return densify(v.order_days(), "zone", "date", ["n"], low, high)


@query(
    "t1_grid_with_null_dates",
    with_sql("ev", "SELECT z.zone, c.date, CAST(coalesce(s.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT zone FROM en WHERE date IS NOT NULL) z CROSS JOIN cn c LEFT JOIN (SELECT zone, date, count(*) AS n FROM en GROUP BY 1, 2) s ON s.zone = z.zone AND s.date = c.date",
             extra="en AS (SELECT zone, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date END AS date FROM ev), "
             "cn AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT min(date) AS lo, max(date) AS hi FROM en))"),
)
def _(v):
    """Events whose date could not be read are in no day of the grid."""
    rows = v.event().withColumn("date", F.when(F.col("event_id") % 5 != 0, F.col("date")))
    return densify(panel.keyed_counts(rows, ["zone", "date"]), "zone", "date", ["n"])


@query(
    "t2_fixed_calendar",
    with_sql("daily", "SELECT c.date, coalesce(d.n, 0) AS n, round(coalesce(d.total, 0), 2) AS total FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS date) c LEFT JOIN daily d ON d.date = c.date"),
)
def _(v):
    day = lambda s: F.lit(s).cast("date")
    out = panel.calendar_series(v.daily(), "date", ["n", "total"], day("1995-01-01"), day("2002-12-31"))
    return out.withColumn("total", F.round("total", 2))


@query("t3_panel_from_events", with_sql("panel", "SELECT zone, date, n FROM panel"))
def _(v):
    return densify(panel.keyed_counts(v.event(), ["zone", "date"]), "zone", "date", ["n"])


_MULTI = (
    "a AS (SELECT zone, date, count(*) AS outcomes FROM oe GROUP BY 1, 2), "
    "b AS (SELECT s_nationkey AS zone, CAST(l_shipdate AS DATE) AS date, count(*) FILTER (l_returnflag = 'R') AS returns, count(*) FILTER (l_discount > 0.05) AS discounts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), "
    "bd AS (SELECT greatest((SELECT min(date) FROM a), (SELECT min(date) FROM b)) AS lo, least((SELECT max(date) FROM a), (SELECT max(date) FROM b)) AS hi), "
    "z AS (SELECT DISTINCT zone FROM a INTERSECT SELECT DISTINCT zone FROM b), c AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bd), "
    "mp AS (SELECT z.zone, c.date, coalesce(a.outcomes, 0) AS outcomes, coalesce(b.returns, 0) AS returns, coalesce(b.discounts, 0) AS discounts FROM z CROSS JOIN c LEFT JOIN a ON a.zone = z.zone AND a.date = c.date LEFT JOIN b ON b.zone = z.zone AND b.date = c.date) "
)


@query("t4_multi_source_panel", with_sql("oe", f"SELECT zone, date, outcomes, returns, discounts, lag(returns, 1, 0) {_ZD}) AS returns_before FROM mp", extra=_MULTI))
def _(v):
    a = v.outcome_daily().withColumnRenamed("n", "outcomes")
    per = v.table("lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("date")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returns"), F.count_if(F.col("l_discount") > 0.05).alias("discounts")
    )
    supp = v.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("zone"))
    b = per.join(supp, "l_suppkey").groupBy("zone", "date").agg(F.sum("returns").alias("returns"), F.sum("discounts").alias("discounts"))
    return panel.common_panel(a, b, "zone", "date", ["outcomes"], ["returns", "discounts"], lagged="returns")


@query(
    "t5_feature_planes",
    with_sql("panel pred", "SELECT p.zone, p.date, p.n, CASE WHEN q.predicted > 2 THEN 1 ELSE 0 END AS is_busy, p.click / (SELECT max(click) FROM panel) AS click_norm, CAST(isodow(p.date) - 1 AS INTEGER) AS weekday FROM panel p JOIN pred q ON q.zone = p.zone", "click_norm"),
)
def _(v):
    p = v.panel()
    static = v.prediction().select("zone", (F.col("predicted") > 2).cast("int").alias("is_busy"))
    scaled = panel.relative_to_max(p.select("zone", "date", "n", "click"), "click", "click_norm")
    return scaled.join(static, "zone").select("zone", "date", "n", "is_busy", "click_norm", F.weekday("date").alias("weekday"))


_STATIONS = (
    "near AS (SELECT a.id, arg_min(b.poly, (2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians(b.y - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.lon) / 2), 2)))), b.poly)) AS poly FROM pt a CROSS JOIN cen b GROUP BY a.id), "
    "st AS (SELECT n.id, coalesce(pip.poly, n.poly) AS zone FROM near n LEFT JOIN pip ON pip.id = n.id), "
    "rd AS (SELECT st.zone, e.date, avg(sqrt(e.amount)) AS rain, avg(e.hour) AS temp FROM ev e JOIN st ON st.id = e.zone GROUP BY 1, 2) "
)


@query(
    "t6_station_aggregate",
    with_sql(
        "pip cen cal ev",
        "SELECT z.n_nationkey AS zone, c.date, coalesce(rain, 0) AS rain, coalesce(temp, 0) AS temp, CASE WHEN strftime(c.date, '%m-%d') IN ('01-01','05-01','09-07','10-12','11-02','11-15','12-25') THEN 1 ELSE 0 END AS holiday "
        "FROM nation z CROSS JOIN cal c LEFT JOIN rd ON rd.zone = z.n_nationkey AND rd.date = c.date",
        "rain temp",
        extra=_STATIONS,
    ),
)
def _(v):
    # stations are the points; a station's readings are the events of one id
    readings = v.event().select(F.col("zone").alias("id"), "date", F.sqrt("amount").alias("rain"), F.col("hour").alias("temp"))
    low, high = panel.bounds(v.event().select("date"))
    days = F.explode(F.sequence(low, high, F.expr("INTERVAL 1 DAY")))
    grid = v.table("nation").select(F.col("n_nationkey").alias("zone")).withColumn("date", days)
    return consolidate.station_planes(grid, readings, v.point(), v.polygon(), ["rain", "temp"])


@query("t7_feature_selection", with_sql("panel", f"SELECT zone, date, n_norm, CAST(lag(n, 1, 0) {_ZD}) AS DOUBLE) AS n_lag1, avg(n) {_ZD} ROWS 6 PRECEDING) AS n_ma7 FROM (SELECT *, n / (SELECT max(n) FROM panel) AS n_norm FROM panel)", "n_norm n_ma7"))
def _(v):
    p = panel.relative_to_max(v.panel().select("zone", "date", "n"), "n", "n_norm")
    full = windows.trailing_volatility(windows.trailing_means(windows.lags(p, "zone", "date", ["n"], (1,)), "zone", "date", ["n"], (7,)), "zone", "date", ["n"])
    return full.select("zone", "date", *panel.feature_columns(full.columns, ["norm", "lag", "ma"]))


@query(
    "t8_sliding_windows",
    with_sql("panel", f"SELECT zone, date, win AS \"window\" FROM (SELECT zone, date, string_agg(CAST(n AS VARCHAR), ',') {_ZD} ROWS 6 PRECEDING) AS win, count(*) {_ZD} ROWS 6 PRECEDING) AS k FROM panel) WHERE k = 7"),
)
def _(v):
    w = panel.sliding_windows(v.panel(), "zone", "date", "n", 7)
    return w.select("zone", "date", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("window"))


@query(
    "t9_window_targets",
    with_sql(
        "panel",
        f"SELECT zone, date, CAST(first_n AS BIGINT) AS first_n, target_at, target_mean FROM (SELECT zone, date, lag(n, 6) {_ZD}) AS first_n, lead(n, 3) {_ZD}) AS target_at, avg(n) {_ZD} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS target_mean FROM panel) WHERE first_n IS NOT NULL AND target_at IS NOT NULL",
        "target_mean",
    ),
)
def _(v):
    t = panel.window_targets(v.panel(), "zone", "date", "n", 7, 3)
    return t.select("zone", "date", F.element_at("window", 1).alias("first_n"), "target_at", "target_mean")


@query(
    "t10_temporal_split",
    with_sql(
        "panel",
        "SELECT split, count(*) AS cells, min(date) AS first_date, max(date) AS last_date FROM (SELECT date, CASE WHEN place < 0.7 THEN 'train' WHEN place < 0.85 THEN 'validation' ELSE 'test' END AS split FROM "
        "(SELECT date, (date - (SELECT min(date) FROM panel)) / ((SELECT max(date) FROM panel) - (SELECT min(date) FROM panel) + 1) AS place FROM panel)) GROUP BY split",
    ),
)
def _(v):
    period = panel.bounds(v.event().select("date"))
    s = panel.temporal_split(v.panel(), "date", {"train": 0.7, "validation": 0.15, "test": 0.15}, period)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("cells"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


_TR = "(SELECT * FROM panel WHERE date < DATE '2024-01-25')"


@query(
    "t11_standardise",
    with_sql("panel", "SELECT zone, date, " + ", ".join(f"({c} - (SELECT avg({c}) FROM {_TR})) / ((SELECT stddev_samp({c}) FROM {_TR}) + 1e-5) AS {c}_std" for c in ("n", "click")) + " FROM panel", "n_std click_std"),
)
def _(v):
    p = v.panel().select("zone", "date", "n", "click")
    return panel.standardise(p, p.filter(F.col("date") < F.lit("2024-01-25").cast("date")), ["n", "click"]).drop("n", "click")


@query(
    "t11_standardise_nonzero",
    with_sql("panel", f"SELECT zone, date, (click - (SELECT avg(click) FROM {_TR} WHERE click <> 0)) / ((SELECT stddev_samp(click) FROM {_TR} WHERE click <> 0) + 1e-5) AS click_std FROM panel", "click_std"),
)
def _(v):
    p = v.panel().select("zone", "date", "click")
    return panel.standardise(p, p.filter(F.col("date") < F.lit("2024-01-25").cast("date")), ["click"], skip_zeros=True).drop("click")


_TOUCH = "tou AS (SELECT DISTINCT a.poly AS src, b.poly AS dst FROM cor a JOIN cor b ON round(a.x, 7) = round(b.x, 7) AND round(a.y, 7) = round(b.y, 7) AND a.poly <> b.poly) "


@query(
    "t12_region_slice",
    with_sql("cor zd", "SELECT t.src, t.dst FROM tou t JOIN zd a ON a.zone = t.src JOIN zd b ON b.zone = t.dst WHERE a.region = 'ASIA' AND b.region = 'ASIA'", extra=_TOUCH),
)
def _(v):
    keep = v.zone_dim().filter(F.col("region") == "ASIA")
    return graph.slice_edges(spatial.touching(v.polygon(), "poly", "ring"), keep, "zone")


@query("t12_panel_slice", with_sql("panel pred", "SELECT zone, date, n FROM panel WHERE zone IN (SELECT zone FROM pred WHERE predicted > 2)"))
def _(v):
    return panel.slice_zones(v.panel().select("zone", "date", "n"), v.prediction().filter("predicted > 2"), "zone")


@query(
    "t13_validation_report",
    with_sql(
        "panel",
        "SELECT count(DISTINCT zone) AS zones, count(DISTINCT date) AS dates, count(*) AS cells, count(*) FILTER (n IS NULL) AS bad_values, count(*) FILTER (n < 0) AS negative_values, "
        "(SELECT count(*) FROM (SELECT zone FROM panel GROUP BY zone HAVING sum(n) = 0)) AS silent_zones, count(DISTINCT date) - 6 AS windows, "
        "(SELECT count(*) FROM (SELECT zone AS e FROM panel GROUP BY zone UNION ALL SELECT zone + 1 FROM panel GROUP BY zone) WHERE e NOT IN (SELECT zone FROM panel)) AS stray_edge_ends, 'edges to unknown zones' AS issues, 'check' AS status FROM panel",
    ),
)
def _(v):
    p = v.panel()
    chain = p.select(F.col("zone").alias("src")).distinct().withColumn("dst", F.col("src") + 1)
    r = panel.validation_report(p, "zone", "date", "n", chain, 7)
    return r.select(*[F.col(c).cast("bigint").alias(c) for c in ("zones", "dates", "cells", "bad_values", "negative_values", "silent_zones", "windows", "stray_edge_ends")], "issues", "status")


@query(
    "t14_extend_zones",
    with_sql(
        "dz cal",
        "SELECT z.zone, c.date, coalesce(d.n, 0) AS n FROM (SELECT zone FROM dz UNION SELECT c_custkey FROM customer) z CROSS JOIN cal c LEFT JOIN dz d ON d.zone = z.zone AND d.date = c.date",
    ),
)
def _(v):
    counts = v.daily_zone().select("zone", "date", "n")
    more = v.table("customer").select(F.col("c_custkey").alias("zone"))
    low, high = panel.bounds(counts)
    return densify(panel.with_seed_zones(counts, more, "zone", "date", low), "zone", "date", ["n"], low, high)


@query(
    "t14_constant_fill",
    with_sql("dz", "SELECT zone, least(1, max(m) / 30) AS fill FROM (SELECT zone, date_trunc('month', date) AS mo, sum(n) AS m FROM dz GROUP BY 1, 2) GROUP BY zone", "fill"),
)
def _(v):
    monthly = v.event().groupBy("zone", F.trunc("date", "month").alias("mo")).agg(F.count(F.lit(1)).alias("m"))
    return monthly.groupBy("zone").agg(F.least(F.lit(1.0), F.max("m") / 30).alias("fill"))


@query("t15_monthly_mean", with_sql("", "WITH oz AS (SELECT zone, date, n FROM (SELECT c_nationkey AS zone, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)), "
       "c AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT min(date) AS lo, max(date) AS hi FROM oz)) "
       "SELECT z.zone, CAST(date_trunc('month', c.date) AS DATE) AS month, round(avg(coalesce(oz.n, 0)), 6) AS mean FROM (SELECT DISTINCT zone FROM oz) z CROSS JOIN c LEFT JOIN oz ON oz.zone = z.zone AND oz.date = c.date GROUP BY 1, 2"))
def _(v):
    low, high = panel.bounds(v.table("orders").select(F.to_date("o_orderdate").alias("date")))
    return densify(v.order_days(), "zone", "date", ["n"], low, high).groupBy("zone", F.trunc("date", "month").alias("month")).agg(F.avg("n").alias("mean"))


@query("t16_network_timeline", with_sql("panel", "SELECT date, avg(n) AS n, avg(click) AS click FROM panel GROUP BY date ORDER BY date DESC LIMIT 10", "n click"))
def _(v):
    return top_k(v.panel().groupBy("date").agg(F.avg("n").alias("n"), F.avg("click").alias("click")), [F.col("date").desc()], 10)


_FEATS = ("n", "click", "view")


@query(
    "t_minimum_slice",
    with_sql(
        "panel",
        "SELECT * FROM (SELECT zone, date, least(greatest(n * 0.4 + click * 0.3 + view * 0.3, 0), 1) AS intensity, "
        f"CAST(lag(n, 1, 0) {_ZD}) AS DOUBLE) AS n_lag1, avg(n) {_ZD} ROWS 6 PRECEDING) AS n_ma7, coalesce(stddev_samp(n) {_ZD} ROWS 6 PRECEDING), 0) AS n_vol7, "
        "sin(2 * pi() * (isodow(date) - 1) / 7) AS dow_sin FROM panel) WHERE date = (SELECT max(date) FROM panel) ORDER BY n_ma7 DESC, zone LIMIT 10",
        "intensity n_ma7 n_vol7 dow_sin",
    ),
)
def _(v):
    full = windows.all_features(v.panel(), "zone", "date", _FEATS)
    _, last = panel.bounds(v.event().select("date"))
    day = full.filter(F.col("date") == last).select("zone", "date", "intensity", "n_lag1", "n_ma7", "n_vol7", "dow_sin")
    return top_k(day, [F.col("n_ma7").desc(), F.col("zone")], 10)
