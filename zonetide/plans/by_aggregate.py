"""G*: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.functions.ladders import SHARE_STEPS, ladder
from zonetide.functions.text import joined_set
from zonetide.operators import aggregates as agg
from zonetide.operators.matching import mapping_stats, match_audit, match_by_ratio
from zonetide.operators.panel import long_form, relative_to_max
from zonetide.operators.ranking import quantiles, scalar_quantile
from zonetide.plans.registry import query
from zonetide.plans.views import best_names, with_sql


@query("g1_daily_zone", with_sql("dz", "SELECT zone, date, n, click, view, purchase FROM dz", "click view purchase"))
def _(v):
    return v.daily_zone()


@query(
    "g2_distinct_list",
    with_sql("ev", "SELECT zone, date, count(*) AS n, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds FROM ev GROUP BY 1, 2"),
)
def _(v):
    return v.event().groupBy("zone", "date").agg(F.count(F.lit(1)).alias("n"), joined_set("kind").alias("kinds"))


@query(
    "g3_month_rollup",
    with_sql(
        "oe",
        "SELECT month, zone, count(*) AS n, CAST(grouping(zone) AS INTEGER) AS is_total "
        "FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, zone FROM oe) GROUP BY GROUPING SETS ((month, zone), (month))",
    ),
)
def _(v):
    return agg.month_rollup(v.outcome_daily().select(F.trunc("date", "month").alias("month"), "zone", "n"), "month", "zone", weight="n")


@query(
    "g4_season_counts",
    with_sql(
        "ev",
        "SELECT zone, 'month' AS part, strftime(date, '%Y-%m') AS month, CAST(NULL AS INTEGER) AS weekday, CAST(NULL AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY ALL "
        "UNION ALL SELECT zone, 'weekday', NULL, CAST(isodow(date) - 1 AS INTEGER), NULL, count(*) FROM ev GROUP BY ALL "
        "UNION ALL SELECT zone, 'hour', NULL, NULL, hour, count(*) FROM ev GROUP BY ALL",
    ),
)
def _(v):
    e = v.event().select("zone", F.date_format("date", "yyyy-MM").alias("month"), F.weekday("date").alias("weekday"), "hour")
    return agg.season_counts(e, ["zone"], {"month": ["month"], "weekday": ["weekday"], "hour": ["hour"]})


@query(
    "g5_share_and_class",
    with_sql("ev", "SELECT zone, kind, n, share, CASE WHEN share * 100 >= 80 THEN 'CRITICO' WHEN share * 100 >= 60 THEN 'ALTO' WHEN share * 100 >= 40 THEN 'MEDIO' ELSE 'BAIXO' END AS class "
             "FROM (SELECT zone, kind, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY zone) AS share FROM ev GROUP BY 1, 2)", "share"),
)
def _(v):
    counts = v.event().groupBy("zone", "kind").agg(F.count(F.lit(1)).alias("n"))
    return agg.share_within(counts, ["zone"], "n").withColumn("class", ladder(F.col("share") * 100, SHARE_STEPS, "BAIXO", inclusive=True))


@query(
    "g6_conditional_counts",
    with_sql("ev", "SELECT z.zone, z.late, k.kind || 's' AS name, count(ev.kind) AS n FROM (SELECT zone, CAST(count(*) FILTER (hour >= 18) AS BIGINT) AS late FROM ev GROUP BY zone) z CROSS JOIN (SELECT DISTINCT kind FROM ev) k LEFT JOIN ev ON ev.zone = z.zone AND ev.kind = k.kind GROUP BY ALL"),
)
def _(v):
    """One count per kind that occurs, turned into rows for the check, and one of the late events."""
    per = v.event().groupBy("zone", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hour") >= 18).alias("_late"))
    wide = per.withColumn("k", F.concat("kind", F.lit("s"))).groupBy("zone").pivot("k").sum("n").na.fill(0)
    counts = wide.unpivot("zone", wide.columns[1:], "name", "n")
    return counts.join(per.groupBy("zone").agg(F.sum("_late").alias("late")), "zone")


@query(
    "g7_pivot_months",
    with_sql("om", "SELECT z.zone, strftime(m.month, '%Y-%m') AS ym, CAST(coalesce(om.y, 0) AS BIGINT) AS y FROM (SELECT DISTINCT zone FROM om) z CROSS JOIN (SELECT DISTINCT month FROM om) m LEFT JOIN om ON om.zone = z.zone AND om.month = m.month"),
)
def _(v):
    """One column per month that occurs, turned into rows for the check."""
    wide = v.outcome_m().withColumn("ym", F.date_format("month", "yyyy-MM")).groupBy("zone").pivot("ym").sum("y").na.fill(0)
    return wide.unpivot("zone", wide.columns[1:], "ym", "y")


@query("g8_monthly_stats", with_sql("om", "SELECT zone, avg(y) AS mean, coalesce(stddev_samp(y), 0) AS std, max(y) AS max, coalesce(stddev_samp(y), 0) / avg(y) AS cv FROM om GROUP BY zone", "mean std cv"))
def _(v):
    return agg.monthly_stats(v.outcome_m(), ["zone"], "y")


_PS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query("g9_exact_percentiles", "SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS {n}" for n, p in _PS.items()) + " FROM lineitem")
def _(v):
    return quantiles(v.table("lineitem").select("l_extendedprice"), "l_extendedprice", _PS)


@query("g9_percentiles_per_group", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_quantity, {p}), 6) AS {n}" for n, p in _PS.items()) + " FROM lineitem GROUP BY 1")
def _(v):
    return quantiles(v.table("lineitem").select("l_returnflag", "l_quantity"), "l_quantity", _PS, ["l_returnflag"])


@query("g10_group_mode", with_sql("ev", "SELECT zone, kind AS top FROM (SELECT zone, kind, row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, kind) AS rn FROM ev GROUP BY 1, 2) WHERE rn = 1"))
def _(v):
    return agg.group_mode(v.event(), ["zone"], "kind")


@query("g11_distinct_counts", with_sql("ev", "SELECT kind, count(DISTINCT zone) AS zones FROM ev GROUP BY kind"))
def _(v):
    return agg.distinct_counts(v.event(), ["kind"], "zone", "zones")


@query("g12_value_shares", "SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def _(v):
    return agg.value_shares(v.table("orders"), "o_orderpriority")


@query(
    "g13_concentration",
    with_sql("ev", "SELECT zone, date, sum(n * n) / (sum(n) * sum(n)) AS concentration, max(n) / sum(n) AS dominance FROM (SELECT zone, date, kind, count(*) AS n FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2", "concentration dominance"),
)
def _(v):
    return agg.concentration(v.event(), ["zone", "date"], "kind")


@query(
    "g14_dominance",
    with_sql("ev", "SELECT zone, kind AS top, n / total AS dominance FROM (SELECT zone, kind, n, sum(n) OVER (PARTITION BY zone) AS total, row_number() OVER (PARTITION BY zone ORDER BY n DESC, kind) AS rn FROM (SELECT zone, kind, count(*) AS n FROM ev GROUP BY 1, 2)) WHERE rn = 1", "dominance"),
)
def _(v):
    e = v.event()
    return agg.group_mode(e, ["zone"], "kind").join(agg.concentration(e, ["zone"], "kind").select("zone", "dominance"), "zone")


@query("g15_mean_to_zone_date", with_sql("ev", "SELECT zone, date, avg(amount) AS amount, avg(hour) AS hour FROM ev GROUP BY 1, 2", "amount hour"))
def _(v):
    return v.event().groupBy("zone", "date").agg(*[F.avg(c).alias(c) for c in ("amount", "hour")])


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS present, count(*) - count({c}) AS missing, count(*) FILTER ({c} = 0) AS zeros, count(DISTINCT {c}) AS \"distinct\", "
    f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS outside FROM lineitem"
    for c, lo, hi in (("l_quantity", 5, 45), ("l_discount", 0, 0.05), ("l_tax", 0, 1))
)


@query("g16_column_profile", _PROFILE)
def _(v):
    cols = ["l_quantity", "l_discount", "l_tax"]
    return agg.column_profile(v.table("lineitem"), cols, {"l_quantity": (5, 45), "l_discount": (0, 0.05), "l_tax": (0, 1)})


@query("g16_duplicate_keys", "SELECT count(*) FILTER (n > 1) AS duplicate_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def _(v):
    return agg.duplicate_keys(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


_LONG = "(" + " UNION ALL ".join(f"SELECT zone, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM panel" for c in ("n", "click", "view", "purchase")) + ")"


@query(
    "g17_tensor_statistics",
    with_sql(
        "panel",
        "SELECT s.*, p.p50, p.p99, z.silent_zones FROM (SELECT feature, count(*) AS cells, count(*) FILTER (value = 0) AS zeros, count(*) FILTER (isnan(value)) AS nans, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, "
        f"avg(value) FILTER (value <> 0) AS mean_nonzero FROM {_LONG} GROUP BY 1) s JOIN (SELECT feature, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM {_LONG} GROUP BY 1) p ON p.feature = s.feature "
        f"JOIN (SELECT feature, count(*) FILTER (t = 0) AS silent_zones FROM (SELECT feature, zone, sum(value) AS t FROM {_LONG} GROUP BY 1, 2) GROUP BY 1) z ON z.feature = s.feature",
        "min max mean std mean_nonzero p50 p99",
    ),
)
def _(v):
    long = long_form(v.panel_table(), ["zone"], ["n", "click", "view", "purchase"])
    x = F.col("value")
    # zones first: the final step then works on one row per zone and feature
    stats = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(x == 0).alias("zeros"), F.count_if(F.isnan(x)).alias("nans"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.avg(F.when(x != 0, x)).alias("mean_nonzero"),
    )
    silent = long.groupBy("feature", "zone").agg(F.sum(x).alias("_t")).groupBy("feature").agg(F.count_if(F.col("_t") == 0).alias("silent_zones"))
    return stats.join(quantiles(long, "value", {"p50": 0.5, "p99": 0.99}, ["feature"]), "feature").join(silent, "feature")


@query(
    "g18_region_summary",
    with_sql("zd", "SELECT region, avg(b) AS mean, max(b) AS max, count(*) FILTER (b > (SELECT quantile_cont(c_acctbal, 0.9) FROM customer)) AS above_p90 FROM (SELECT region, c_acctbal AS b FROM customer JOIN zd ON zone = c_nationkey) GROUP BY 1", "mean max"),
)
def _(v):
    c = v.table("customer").select(F.col("c_nationkey").alias("zone"), F.col("c_acctbal").alias("b"))
    cut = scalar_quantile(c, "b", 0.9)
    return c.join(v.zone_dim(), "zone").groupBy("region").agg(F.avg("b").alias("mean"), F.max("b").alias("max"), F.count_if(F.col("b") > cut).alias("above_p90"))


@query(
    "g19_consistency_a",
    with_sql("om", "SELECT zone, 1 / (1 + avg(s) / avg(m)) AS consistency FROM (SELECT zone, month(month) AS mm, avg(y) AS m, stddev_samp(y) AS s FROM om GROUP BY 1, 2) GROUP BY zone", "consistency"),
)
def _(v):
    return agg.consistency_of_stats(v.outcome_m().withColumn("mm", F.month("month")), ["zone"], "mm", "y")


@query(
    "g20_consistency_b",
    with_sql("om", "SELECT zone, 1 / (1 + stddev_samp(m) / avg(m)) AS consistency FROM (SELECT zone, month(month) AS mm, avg(y) AS m, sum(y) AS t FROM om GROUP BY 1, 2) GROUP BY zone HAVING sum(t) >= 10", "consistency"),
)
def _(v):
    return agg.consistency_of_means(v.outcome_m().withColumn("mm", F.month("month")), ["zone"], "mm", "y", min_total=10)


@query(
    "g21_consistency_c",
    with_sql("om", "SELECT zone, 1 / (1 + stddev_samp(m) / avg(m)) AS consistency FROM (SELECT zone, month(month) AS mm, avg(y) AS m FROM om GROUP BY 1, 2) GROUP BY zone", "consistency"),
)
def _(v):
    return agg.consistency_of_means(v.outcome_m().withColumn("mm", F.month("month")), ["zone"], "mm", "y")


@query(
    "g22_stability",
    with_sql("dz", "SELECT zone, CASE WHEN count(*) < 2 THEN 0.5 WHEN avg(click) = 0 THEN 0 ELSE least(1 / (1 + stddev_samp(click) / avg(click)), 1) END AS stability FROM dz GROUP BY zone", "stability"),
)
def _(v):
    return agg.zone_stability(v.daily_zone(), "zone", "click")


@query("g23_relative_index", with_sql("ev", "SELECT zone, count(*) AS n, count(*) / max(count(*)) OVER () AS index FROM ev GROUP BY zone", "index"))
def _(v):
    return relative_to_max(v.event().groupBy("zone").agg(F.count(F.lit(1)).alias("n")), "n")


@query("g24_exogenous_counts", with_sql("zd", "SELECT zone, count(s_suppkey) AS events, count(s_suppkey) > 0 AS has_events FROM zd LEFT JOIN supplier ON s_nationkey = zone AND s_acctbal > 8000 GROUP BY zone"))
def _(v):
    counts = v.table("supplier").filter("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("zone")).agg(F.count(F.lit(1)).alias("events"))
    return v.zone_dim().select("zone").join(counts, "zone", "left").na.fill(0, subset=["events"]).withColumn("has_events", F.col("events") > 0)


_RAW = "raw AS (SELECT CASE WHEN c_nationkey % 5 = 0 THEN c_mktsegment || '-' || c_nationkey ELSE replace(upper(n_name), 'T', '') END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey)"


@query(
    "g25_mapping_quality",
    f"WITH RECURSIVE {_RAW}, off AS (SELECT n_name AS o FROM nation), {best_names(0.8)}, "
    "aud AS (SELECT m.name, matched, (SELECT count(*) FROM raw r WHERE r.name = m.name) AS rows FROM m) "
    "SELECT count(*) AS names, count(matched) AS matched_names, round(count(matched) * 100.0 / count(*), 6) AS pct_names, round(sum(CASE WHEN matched IS NOT NULL THEN rows ELSE 0 END) * 100.0 / sum(rows), 6) AS pct_rows, "
    "round(count(DISTINCT matched) * 100.0 / (SELECT count(*) FROM nation), 6) AS list_covered FROM aud",
)
def _(v):
    n = v.table("nation")
    c = v.table("customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    raw = c.select(F.when(F.col("c_nationkey") % 5 == 0, F.concat_ws("-", "c_mktsegment", "c_nationkey")).otherwise(F.regexp_replace(F.upper("n_name"), "T", "")).alias("name"))
    matches = match_by_ratio(raw, "name", n, "n_name", 0.8)
    return mapping_stats(match_audit(raw, "name", matches), n, "n_name")
