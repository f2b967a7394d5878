"""Risk tables, recommendations and zone cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.functions.ladders import regional_alert
from zonetide.functions.numbers import percent_change, ratio
from zonetide.operators.aggregates import counted, group_mode, share_within
from zonetide.operators.forecast import critical_override
from zonetide.operators.ranking import by_custom_order, top_k, top_k_per_group
from zonetide.operators.windows import window_compare

PRIORITIES = ["CRITICO", "ALTO", "MEDIO", "BAIXO"]


def effective_start(events: DataFrame, date: str, start: Column, end: Column, fallback_days: int = 90) -> Column:
    """``start``, or ``end`` minus the fallback when the window is empty.

    The test is a one-row aggregate used as a scalar; nothing is collected.
    """
    rows = events.filter(F.col(date).between(start, end)).select(F.count(F.lit(1))).scalar()
    return F.when(rows > 0, start).otherwise(F.date_sub(end, fallback_days))


def recommendations(
    predictions: DataFrame, events: DataFrame, zone: str, date: str, outcome: Column, risk: str, start: Column, end: Column, top: int = 15, shown: int = 10,
    second: Column | None = None, labels: DataFrame | None = None, label: str = "label", unknown: str = "DESCONHECIDA",
) -> DataFrame:
    """Action, priority, team delta and confidence of the riskiest zones that have events.

    An empty window is widened to the 90 days before its end.  ``second`` counts
    another kind of events in both windows; ``labels`` (zone, label) adds the
    dominant label, with a default.  Filter ``events`` to a region beforehand.
    """
    start = effective_start(events, date, start, end)
    days = F.datediff(end, start)
    d = F.col(date)
    known = predictions.join(events.select(zone).distinct(), zone, "left_semi")
    picked = top_k(known.select(zone, risk), [F.col(risk).desc(), F.col(zone)], top)
    others = {} if second is None else {"others": F.count_if(second & (d >= start)), "others_history": F.count_if(second)}
    window = events.filter(d.between(F.date_sub(start, days), end)).join(picked.select(zone), zone, "left_semi")
    recent = window.groupBy(zone).agg(
        F.count_if(outcome & (d >= start)).alias("outcomes"),
        F.count_if(outcome).alias("outcomes_history"),
        F.count_if(d >= start).alias("events"),
        F.count_if(d < start).alias("events_before"),
        *[e.alias(n) for n, e in others.items()],
    )
    rows = picked.join(recent, zone, "left").na.fill(0, subset=["outcomes", "outcomes_history", "events", "events_before", *others])
    if labels is not None:
        named = F.when(F.col(label) != "-", F.col(label))
        rows = rows.join(labels.select(zone, label), zone, "left").withColumn(label, F.coalesce(named, F.lit(unknown)))
    trend = percent_change(F.col("events"), F.col("events_before"), "hundred")
    rows = rows.withColumn("trend", trend)
    history, now, r = F.col("outcomes_history"), F.col("outcomes"), F.col(risk)

    def pick(intensify, raise_, keep, quiet, falling, other):
        return (
            F.when(history > 10, intensify).when(history > 5, raise_).when((history > 0) | (r > 0.25), keep)
            .when((r < 0.15) & (history == 0) & (F.col("events_before") == 0), quiet)
            .when((F.col("trend") < -50) & (now == 0) & (r < 0.20), falling).otherwise(other)
        )

    rows = rows.withColumns({
        "action": pick("INTENSIFICAR", "AUMENTAR", "MANTER", "REDUZIR", "REDUZIR", "MANTER"),
        "priority": pick("CRITICO", "ALTO", "MEDIO", "BAIXO", "BAIXO", "MEDIO"),
        "teams": pick(3, 2, 0, -1, -1, 0),
        "peak_hours": F.when((now > 3) | (history > 15), "20h-04h").otherwise("18h-06h"),
        "confidence": F.when(history > 0, 90).otherwise(80),
    })
    return by_custom_order(rows, "priority", PRIORITIES, F.col(risk).desc(), F.col(zone)).drop("place").limit(shown)


def recommendation_totals(rows: DataFrame) -> DataFrame:
    teams = F.coalesce(F.sum(F.when(F.col("teams") > 0, F.col("teams"))), F.lit(0))
    return rows.agg(teams.alias("teams"), F.least(teams * 6, F.lit(40)).alias("impact"), F.avg("confidence").alias("confidence"))


def risk_table(zones: DataFrame, predictions: DataFrame, events: DataFrame, extra: DataFrame, zone: str, kind: str, risk: str, region: str, weight: str | None = None) -> DataFrame:
    """Prediction, alert class with critical override, dominant kind, counts of
    events and of exogenous events with a flag."""
    counts = events.groupBy(zone).agg(counted(weight).alias("events"))
    tops = group_mode(events, [zone], kind, "top_kind", weight)
    more = extra.groupBy(zone).agg(F.count(F.lit(1)).alias("exogenous"))
    rows = (
        zones.join(predictions.select(zone, risk), zone, "left").join(counts, zone, "left").join(tops, zone, "left").join(more, zone, "left")
        .na.fill(0, subset=["events", "exogenous"]).withColumn(risk, F.coalesce(F.col(risk), F.lit(0.0)))
        .withColumn("alert", regional_alert(F.col(risk), F.col(region))).withColumn("has_exogenous", F.col("exogenous") > 0)
    )
    return critical_override(rows, risk, "alert")


def top_territories(events: DataFrame, region: str, zone: str, label: str, k: int = 10, weight: str | None = None) -> DataFrame:
    """The k zones with most events per region, with their dominant label."""
    counts = events.groupBy(region, zone).agg(counted(weight).alias("events"))
    best = top_k_per_group(counts, [region], [F.col("events").desc(), F.col(zone)], k)
    return best.join(group_mode(events, [zone], label, "dominant", weight), zone, "left")


def presence(events: DataFrame, label: str, zone: str) -> DataFrame:
    """Events and distinct zones per label, with their shares."""
    cells = events.groupBy(label, zone).agg(F.count(F.lit(1)).alias("_n"))
    rows = cells.groupBy(label).agg(F.sum("_n").alias("events"), F.count(F.lit(1)).alias("zones"))
    all_zones = events.select(zone).distinct().select(F.count(F.lit(1))).scalar()
    rows = share_within(rows, [], "events", "_s").withColumn("pct_events", F.col("_s") * 100).drop("_s")
    return rows.withColumn("pct_zones", ratio(F.col("zones") * 100, all_zones))


def zone_cards(panel: DataFrame, zone: str, date: str, value: str, region: DataFrame) -> DataFrame:
    """Score out of 100, totals, active days and last active date per zone."""
    v = F.col(value)
    cards = panel.groupBy(zone).agg(
        F.sum(v).alias("total"), F.avg(v).alias("mean"), F.max(v).alias("peak"), F.count_if(v > 0).alias("active_days"),
        F.max(F.when(v > 0, F.col(date))).alias("last_active"),
    )
    top = cards.select(F.max("total")).scalar()
    return cards.withColumn("score", ratio(F.col("total") * 100, top)).join(region, zone, "left")


def period_trend(events: DataFrame, zone: str, date: str, start: Column, end: Column) -> DataFrame:
    """Current and previous window counts with their percent change."""
    rows = window_compare(events, zone, date, start, end)
    return rows.withColumn("trend", percent_change(F.col("current"), F.col("previous"), "hundred"))
