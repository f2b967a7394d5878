"""STR*: Structured Streaming over the same events."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.operators.windows import trailing_count
from zonetide.plans.registry import query
from zonetide.plans.views import with_sql
from zonetide.streaming import flows


def _stream(v):
    schema = v.table("events").schema
    return flows.event_stream(v.spark, v.sf_dir, schema, "events.parquet", "ts")


@query(
    "str1_event_intake",
    "SELECT event_type <> 'error' AS accepted, count(*) AS n FROM events GROUP BY 1",
)
def _(v):
    # events of one type lose a required field and must land among the rejects
    s = _stream(v).withColumn("details", F.when(F.col("event_type") != "error", F.col("props")))
    marked = flows.split_valid(s, ["event_type", "ts", "details"])
    table = flows.run_to_table(marked, "intake", ["accepted"])
    return table.groupBy("accepted").agg(F.count(F.lit(1)).alias("n"))


@query(
    "str2_tumbling_counts",
    with_sql("ev", "SELECT date, zone, count(*) AS n FROM ev WHERE CAST(date + 1 AS TIMESTAMP) <= (SELECT max(ts) FROM ev) - INTERVAL 2 DAY GROUP BY 1, 2"),
)
def _(v):
    s = _stream(v).withColumnRenamed("user_id", "zone")
    return flows.run_to_table(flows.tumbling_counts(s, "ts", ["zone"]), "tumbling").select("date", "zone", "n")


@query(
    "str2_sliding_counts",
    with_sql(
        "ev",
        "SELECT w.until, kind, count(*) AS n FROM ev JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-02', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS until) w ON ev.date < w.until AND ev.date >= w.until - 7 WHERE CAST(w.until AS TIMESTAMP) <= (SELECT max(ts) FROM ev) - INTERVAL 2 DAY GROUP BY 1, 2",
    ),
)
def _(v):
    s = _stream(v).withColumnRenamed("event_type", "kind")
    return flows.run_to_table(flows.sliding_counts(s, "ts", ["kind"], "7 days", "1 day"), "sliding").select("until", "kind", "n")


@query(
    "str2_trailing_on_daily_state",
    with_sql(
        "ev",
        "SELECT date, kind, n, CAST(sum(n) OVER (PARTITION BY kind ORDER BY date RANGE BETWEEN INTERVAL 179 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing FROM (SELECT date, kind, count(*) AS n FROM ev WHERE CAST(date + 1 AS TIMESTAMP) <= (SELECT max(ts) FROM ev) - INTERVAL 2 DAY GROUP BY 1, 2)",
    ),
)
def _(v):
    # the stream keeps one count per day; the long frame runs on its output
    s = _stream(v).withColumnRenamed("event_type", "kind")
    daily = flows.run_to_table(flows.tumbling_counts(s, "ts", ["kind"]), "daily").select("date", "kind", "n")
    return trailing_count(daily, "kind", "date", "n", 180, inclusive=True)


@query(
    "str2_trailing_counts",
    with_sql(
        "ev",
        "SELECT w.until, kind, CAST(count(*) FILTER (ev.date >= w.until - 7) AS BIGINT) AS n7, CAST(count(*) FILTER (ev.date >= w.until - 30) AS BIGINT) AS n30, count(*) AS n180 FROM ev "
        "JOIN (SELECT CAST(unnest(generate_series(min(date) + 1, max(date) + 180, INTERVAL 1 DAY)) AS DATE) AS until FROM ev) w ON ev.date < w.until AND ev.date >= w.until - 180 WHERE CAST(w.until AS TIMESTAMP) <= (SELECT max(ts) FROM ev) - INTERVAL 2 DAY GROUP BY 1, 2",
    ),
)
def _(v):
    s = _stream(v).withColumnRenamed("event_type", "kind")
    return flows.run_to_table(flows.trailing_counts(s, "ts", ["kind"], (7, 30, 180)), "trailing").select("until", "kind", "n7", "n30", "n180")


@query("str3_stream_dedup", "SELECT event_id, user_id, value FROM events")
def _(v):
    s = _stream(v)
    # every event arrives twice
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return flows.run_to_table(flows.drop_repeats(twice, ["event_id"], "ts"), "dedup").select("event_id", "user_id", "value")


@query(
    "str4_stream_static_join",
    with_sql("zd", "SELECT event_id, coalesce(z.zone_name, 'SEM DADO') AS zone_name FROM events LEFT JOIN zd z ON z.zone = user_id"),
)
def _(v):
    dim = v.zone_dim().select(F.col("zone").cast("bigint").alias("user_id"), "zone_name")
    s = flows.enrich(_stream(v).select("event_id", "user_id"), dim, "user_id")
    return flows.run_to_table(s, "enriched").select("event_id", F.coalesce("zone_name", F.lit("SEM DADO")).alias("zone_name"))


@query(
    "str4_stream_point_in_polygon",
    with_sql("pip", "SELECT e.event_id, coalesce(pip.poly, -1) AS poly FROM events e JOIN pt ON pt.id = e.event_id LEFT JOIN pip ON pip.id = pt.id"),
)
def _(v):
    """Events that have a point, placed on the way in."""
    points = v.point().withColumnRenamed("id", "event_id")
    s = _stream(v).select("event_id").join(points, "event_id")
    placed = flows.place(s, v.polygon(), "poly", "ring", "lon", "lat")
    return flows.run_to_table(placed, "placed").select("event_id", F.coalesce("poly", F.lit(-1)).alias("poly"))
