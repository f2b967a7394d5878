"""E* and R*: name matching, recommendations, risk tables and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.functions.ladders import two_column_ladder
from zonetide.operators import matching, rules
from zonetide.operators.aggregates import group_mode
from zonetide.operators.ranking import keep_first
from zonetide.plans.registry import query
from zonetide.plans.views import best_names, with_sql

# Raw names: the part's words in their own case with blanks around them, some with one letter dropped, some unknown.
_RAW = "raw AS (SELECT p_partkey AS id, CASE WHEN p_type = 'ECONOMY' THEN ' ' || p_name WHEN p_size > 20 THEN left(p_name, 2) || substr(p_name, 4) || ' ' ELSE upper(p_brand || '@') END AS name FROM part), off AS (SELECT DISTINCT upper(p_name) AS o FROM part WHERE p_type = 'ECONOMY'), "
_BEST = "WITH RECURSIVE " + _RAW + best_names(0.7)
_BY_DISTANCE = "WITH " + _RAW + (
    "nm AS (SELECT DISTINCT name, upper(trim(name)) AS a FROM raw), sc AS (SELECT name, o, 1 - levenshtein(a, o) / greatest(length(a), length(o)) AS s FROM nm CROSS JOIN off), "
    "m AS (SELECT nm.name, CASE WHEN b.s >= 0.7 THEN b.o END AS matched, b.s AS score FROM nm LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, o) AS rn FROM sc) b ON b.name = nm.name AND rn = 1) "
)


def _raw(v):
    key, name = F.col("p_partkey"), F.col("p_name")
    text = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit(" "), name)).when(F.col("p_size") > 20, F.concat(F.substring(name, 1, 2), F.expr("substring(p_name, 4)"), F.lit(" "))).otherwise(
        F.upper(F.concat("p_brand", F.lit("@")))
    )
    return v.table("part").select(key.alias("id"), text.alias("name"))


def _official(v):
    return v.table("part").filter("p_type = 'ECONOMY'").select(F.upper("p_name").alias("o")).distinct()


def _matches(v, raw):
    return matching.match_by_ratio(raw, "name", _official(v), "o", 0.7)


@query("e1_match_by_distance", _BY_DISTANCE + "SELECT name, matched, round(score, 6) + 0.0 AS score FROM m")
def _(v):
    return matching.match_by_distance(_raw(v), "name", _official(v), "o", 0.7, scored=True)


@query("e1_match_by_ratio", "WITH RECURSIVE " + _RAW + best_names(0.5) + "SELECT name, matched, round(score, 6) + 0.0 AS score FROM m")
def _(v):
    return matching.match_by_ratio(_raw(v), "name", _official(v), "o", 0.5)


@query("e2_keep_or_unknown", _BEST + "SELECT id, coalesce(matched, nullif(trim(raw.name), ''), 'NAO INFORMADO') AS standard FROM raw LEFT JOIN m ON m.name = raw.name")
def _(v):
    raw = _raw(v)
    return matching.apply_matches(raw, "name", _matches(v, raw)).select("id", "standard")


@query("e2_unknown_literal", _BEST + "SELECT id, coalesce(matched, 'NAO INFORMADO') AS standard FROM raw LEFT JOIN m ON m.name = raw.name")
def _(v):
    raw = _raw(v)
    return matching.apply_matches(raw, "name", _matches(v, raw), keep_original=False).select("id", "standard")


@query("e3_mapping_audit", _BEST + "SELECT m.name, matched, round(score, 6) + 0.0 AS score, count(raw.id) AS rows, CASE WHEN matched IS NULL THEN 'unmatched' ELSE 'matched' END AS status FROM m LEFT JOIN raw ON raw.name = m.name GROUP BY ALL")
def _(v):
    raw = _raw(v)
    return matching.match_audit(raw, "name", _matches(v, raw))


@query("e4_report_remap", _BEST + "SELECT id, coalesce(matched, upper(trim(raw.name))) AS name FROM raw LEFT JOIN m ON m.name = raw.name AND matched IS NOT NULL")
def _(v):
    raw = _raw(v)
    stored = _matches(v, raw).filter("matched IS NOT NULL")
    return matching.remap(raw, "name", stored, "name", "matched").select("id", "name")


_START, _END = "2024-01-20", "2024-01-30"

def _rec(before: str, start: str, end: str, where: str = "TRUE") -> str:
    """The recommendation rules in SQL, for one window and the one before it."""
    return (
        f"evr AS (SELECT * FROM ev WHERE {where}), "
        "rk AS (SELECT zone, predicted / 10 AS risk FROM pred WHERE zone IN (SELECT zone FROM evr) ORDER BY predicted / 10 DESC, zone LIMIT 15), "
        f"cnt AS (SELECT zone, count(*) FILTER (kind = 'purchase' AND date >= DATE '{start}') AS outcomes, count(*) FILTER (kind = 'purchase') AS outcomes_history, count(*) FILTER (date >= DATE '{start}') AS events, count(*) FILTER (date < DATE '{start}') AS events_before, "
        f"count(*) FILTER (kind = 'view' AND date >= DATE '{start}') AS others, count(*) FILTER (kind = 'view') AS others_history FROM evr WHERE date BETWEEN DATE '{before}' AND DATE '{end}' GROUP BY zone), "
        "rr AS (SELECT rk.zone, risk, coalesce(outcomes, 0) AS outcomes, coalesce(outcomes_history, 0) AS outcomes_history, coalesce(events, 0) AS events, coalesce(events_before, 0) AS events_before, coalesce(others, 0) AS others, coalesce(others_history, 0) AS others_history, "
        "CASE WHEN events_before > 0 THEN (events - events_before) * 100.0 / events_before WHEN events > 0 THEN 100 ELSE 0 END AS trend FROM rk LEFT JOIN cnt ON cnt.zone = rk.zone), "
        "ru AS (SELECT *, CASE WHEN outcomes_history > 10 THEN 1 WHEN outcomes_history > 5 THEN 2 WHEN outcomes_history > 0 OR risk > 0.25 THEN 3 WHEN risk < 0.15 AND outcomes_history = 0 AND events_before = 0 THEN 4 WHEN trend < -50 AND outcomes = 0 AND risk < 0.2 THEN 5 ELSE 6 END AS rule FROM rr), "
        "rx AS (SELECT zone, risk, outcomes, outcomes_history, events, events_before, others, others_history, trend, (['INTENSIFICAR','AUMENTAR','MANTER','REDUZIR','REDUZIR','MANTER'])[rule] AS action, (['CRITICO','ALTO','MEDIO','BAIXO','BAIXO','MEDIO'])[rule] AS priority, CAST(([3,2,0,-1,-1,0])[rule] AS INTEGER) AS teams, "
        "CASE WHEN outcomes > 3 OR outcomes_history > 15 THEN '20h-04h' ELSE '18h-06h' END AS peak_hours, CAST(CASE WHEN outcomes_history > 0 THEN 90 ELSE 80 END AS INTEGER) AS confidence FROM ru), "
        "rz AS (SELECT * FROM rx ORDER BY list_position(['CRITICO','ALTO','MEDIO','BAIXO'], priority), risk DESC, zone LIMIT 10) "
    )


_REC = _rec("2024-01-10", "2024-01-20", "2024-01-30")


def _recommend(v, shown=10):
    p = v.prediction().select("zone", (F.col("predicted") / 10).alias("risk"))
    day = lambda s: F.lit(s).cast("date")
    return rules.recommendations(p, v.event(), "zone", "date", F.col("kind") == "purchase", "risk", day(_START), day(_END), shown=shown)


@query("r1_recommendations", with_sql("pred ev", "SELECT * EXCLUDE (others, others_history) FROM rz", "risk trend", extra=_REC))
def _(v):
    return _recommend(v)


@query(
    "r1_recommendations_of_region",
    with_sql(
        "pred ev snap zd",
        "SELECT rz.*, coalesce(CASE WHEN l.label <> 'view' THEN l.label END, 'DESCONHECIDA') AS label FROM rz LEFT JOIN (SELECT zone, label FROM snap WHERE date = (SELECT max(date) FROM snap)) l ON l.zone = rz.zone",
        "risk trend",
        extra=_rec("2023-08-14", "2023-11-12", "2024-02-10", "zone IN (SELECT zone FROM zd WHERE region = 'ASIA')"),
    ),
)
def _(v):
    """One region of the zone table, a window without events, a second kind of events, and labels of which one means none."""
    p = v.prediction().select("zone", (F.col("predicted") / 10).alias("risk"))
    day = lambda s: F.lit(s).cast("date")
    last = keep_first(v.snapshot(), ["zone"], [F.col("date").desc()])
    labels = last.select("zone", F.when(F.col("label") == "view", "-").otherwise(F.col("label")).alias("label"))
    return rules.recommendations(
        p, v.event().join(v.zone_dim().filter("region = 'ASIA'").select("zone"), "zone", "left_semi"), "zone", "date", F.col("kind") == "purchase", "risk", day("2024-02-05"), day("2024-02-10"),
        second=F.col("kind") == "view", labels=labels,
    )


@query("r1_recommendation_totals", with_sql("pred ev", "SELECT CAST(coalesce(sum(teams) FILTER (teams > 0), 0) AS BIGINT) AS teams, CAST(least(coalesce(sum(teams) FILTER (teams > 0), 0) * 6, 40) AS BIGINT) AS impact, avg(confidence) AS confidence FROM rx", "confidence", extra=_REC))
def _(v):
    return rules.recommendation_totals(_recommend(v, shown=15))


_RISK = (
    "q AS (SELECT s_nationkey AS zone, avg(s_acctbal) / 50000 AS risk FROM supplier GROUP BY 1), oc AS (SELECT c_nationkey AS zone, o_orderpriority AS kind FROM orders JOIN customer ON o_custkey = c_custkey), "
    "tk AS (SELECT zone, kind FROM (SELECT zone, kind, row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, kind) AS rn FROM oc GROUP BY 1, 2) WHERE rn = 1), "
    "rt AS (SELECT zd.zone, CASE WHEN region = 'ASIA' THEN 'RMF' WHEN region = 'EUROPE' THEN 'INTERIOR' ELSE 'CAPITAL' END AS region, coalesce(q.risk, 0) AS risk, (SELECT count(*) FROM oc WHERE oc.zone = zd.zone) AS events, tk.kind AS top_kind, (SELECT count(*) FROM supplier WHERE s_nationkey = zd.zone AND s_acctbal < 1000) AS exogenous FROM zd LEFT JOIN q ON q.zone = zd.zone LEFT JOIN tk ON tk.zone = zd.zone), "
    "ra AS (SELECT *, exogenous > 0 AS has_exogenous, risk >= (SELECT quantile_cont(risk, 0.9) FROM rt) * 1.15 AS critical, risk * CASE region WHEN 'INTERIOR' THEN 30 WHEN 'RMF' THEN 6 ELSE 3 END AS k FROM rt) "
)


@query(
    "r2_risk_table",
    with_sql("zd", "SELECT zone, region, risk, events, top_kind, exogenous, has_exogenous, critical, CASE WHEN critical OR k > 0.8 THEN 'CRITICO' WHEN k > 0.5 THEN 'ALTO' WHEN k > 0.2 THEN 'MEDIO' ELSE 'BAIXO' END AS alert FROM ra", "risk", extra=_RISK),
)
def _(v):
    region = F.when(F.col("region") == "ASIA", "RMF").when(F.col("region") == "EUROPE", "INTERIOR").otherwise("CAPITAL")
    zones = v.zone_dim().select("zone", region.alias("region"))
    preds = v.table("supplier").groupBy(F.col("s_nationkey").alias("zone")).agg((F.avg("s_acctbal") / 50000).alias("risk"))
    extra = v.table("supplier").filter("s_acctbal < 1000").select(F.col("s_nationkey").alias("zone"))
    events = v.order_counts("o_orderpriority").withColumnRenamed("label", "kind")
    return rules.risk_table(zones, preds, events, extra, "zone", "kind", "risk", "region", weight="n")


_OCR = "oc AS (SELECT z.region, z.zone, o_orderstatus AS label FROM orders JOIN customer ON o_custkey = c_custkey JOIN zd z ON z.zone = c_nationkey)"


@query(
    "r3_top_territories",
    with_sql("zd", "SELECT t.region, t.zone, t.events, CAST(t.pos AS INTEGER) AS pos, m.label AS dominant FROM (SELECT region, zone, count(*) AS events, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, zone) AS pos FROM oc GROUP BY 1, 2) t JOIN "
             "(SELECT zone, label FROM (SELECT zone, label, row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, label) AS rn FROM oc GROUP BY 1, 2) WHERE rn = 1) m ON m.zone = t.zone WHERE t.pos <= 3", extra=_OCR),
)
def _(v):
    events = v.order_counts("o_orderstatus").join(v.zone_dim().select("zone", "region"), "zone")
    return rules.top_territories(events, "region", "zone", "label", 3, weight="n")


_OCR_1997 = (
    "oc AS (SELECT z.region, z.zone, o_orderpriority AS label FROM orders JOIN customer ON o_custkey = c_custkey JOIN zd z ON z.zone = c_nationkey "
    "WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' AND z.region = 'ASIA')"
)


@query(
    "r3_top_territories_in_period",
    with_sql(
        "zd",
        "SELECT t.region, t.zone, t.events, CAST(t.pos AS INTEGER) AS pos, m.label AS dominant FROM (SELECT region, zone, count(*) AS events, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, zone) AS pos FROM oc GROUP BY 1, 2) t JOIN "
        "(SELECT zone, label FROM (SELECT zone, label, row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, label) AS rn FROM oc GROUP BY 1, 2) WHERE rn = 1) m ON m.zone = t.zone WHERE t.pos <= 10",
        extra=_OCR_1997,
    ),
)
def _(v):
    t = F.col("o_orderdate")
    period = (t >= F.lit("1997-01-01").cast("timestamp_ntz")) & (t < F.lit("1998-01-01").cast("timestamp_ntz"))
    asia = v.zone_dim().filter("region = 'ASIA'").select("zone", "region")
    events = v.order_counts("o_orderpriority", period).join(asia, "zone")
    return rules.top_territories(events, "region", "zone", "label", 10, weight="n")


@query(
    "r4_presence",
    with_sql("ev", "SELECT kind, count(*) AS events, count(DISTINCT zone) AS zones, count(*) * 100.0 / (SELECT count(*) FROM ev) AS pct_events, count(DISTINCT zone) * 100.0 / (SELECT count(DISTINCT zone) FROM ev) AS pct_zones FROM ev GROUP BY kind", "pct_events pct_zones"),
)
def _(v):
    return rules.presence(v.event().select("kind", "zone"), "kind", "zone")


@query(
    "r5_zone_cards",
    with_sql(
        "panel",
        "SELECT zone, CAST(sum(n) AS BIGINT) AS total, avg(n) AS mean, max(n) AS peak, count(*) FILTER (n > 0) AS active_days, max(CASE WHEN n > 0 THEN date END) AS last_active, sum(n) * 100.0 / max(sum(n)) OVER () AS score, any_value(g.top) AS region FROM panel JOIN (SELECT zone AS gz, kind AS top FROM (SELECT zone, kind, row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, kind) AS rn FROM ev GROUP BY 1, 2) WHERE rn = 1) g ON g.gz = panel.zone GROUP BY zone",
        "mean score",
    ),
)
def _(v):
    region = group_mode(v.event(), ["zone"], "kind", "region")
    return rules.zone_cards(v.panel(), "zone", "date", "n", region)


@query(
    "r6_volatility_ladder",
    with_sql("cp", "SELECT zone, CASE WHEN p > 0.5 OR q > 0.7 THEN 'CRITICO' WHEN p > 0.3 OR q > 0.4 THEN 'ALTO' WHEN p > 0.1 OR q > 0.2 THEN 'MEDIO' ELSE 'BAIXO' END AS class FROM (SELECT zone, sum(changed) / 6 AS p, stddev_pop(n) / (max(n) + 1e-6) AS q FROM cp GROUP BY zone)"),
)
def _(v):
    # label changes per snapshot, and the deviation against the largest day
    rows = v.change_panel().groupBy("zone").agg((F.sum("changed") / 6).alias("p"), (F.stddev_pop("n") / (F.max("n") + 1e-6)).alias("q"))
    return rows.select("zone", two_column_ladder(F.col("p"), F.col("q")).alias("class"))


@query(
    "r1_period_trend",
    with_sql("ev", "SELECT zone, c AS current, p AS previous, CASE WHEN p > 0 THEN (c - p) * 100.0 / p WHEN c > 0 THEN 100 ELSE 0 END AS trend FROM (SELECT zone, count(*) FILTER (date >= DATE '2024-01-16') AS c, count(*) FILTER (date < DATE '2024-01-16') AS p FROM ev WHERE date BETWEEN DATE '2024-01-02' AND DATE '2024-01-30' GROUP BY zone)", "trend"),
)
def _(v):
    return rules.period_trend(v.event(), "zone", "date", F.lit("2024-01-16").cast("date"), F.lit("2024-01-30").cast("date"))

