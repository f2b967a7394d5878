"""The life of the data end to end: consolidation, features, seasonality."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.operators import aggregates as agg
from zonetide.operators import consolidate
from zonetide.operators.ranking import keep_first
from zonetide.plans.registry import query
from zonetide.plans.views import AMOUNTS, with_sql
from zonetide.session import scratch_path
from zonetide.sources.files import write_partitioned

_LAYER = "CASE z.region WHEN 'ASIA' THEN 'CAPITAL' WHEN 'EUROPE' THEN 'RMF' ELSE 'INTERIOR' END"


@query(
    "flow_consolidate",
    with_sql(
        "pip zd snap",
        f"SELECT p.id, z.zone_name AS zone, {_LAYER} AS layer, CASE WHEN e.label % 2 = 0 THEN 'CVLI' ELSE 'CVP' END AS kind, coalesce(s.label, 'NEUTRO') AS label FROM pip p JOIN zd z ON z.zone = p.poly "
        "JOIN embeddings e ON e.vec_id = p.id LEFT JOIN (SELECT zone, label FROM snap WHERE date = (SELECT max(date) FROM snap) AND label <> 'view') s ON s.zone = p.poly",
    ),
)
def _(v):
    # raw spellings: other column names, comma decimals, accents
    comma = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.", ",")
    nature = F.when(F.col("label") % 2 == 0, "Homicídio doloso").otherwise("Roubo a pessoa")
    kinds = v.table("embeddings").select(F.col("vec_id").alias("id"), nature.alias("ds_natureza"))
    raw = v.point().select("id", comma("lat").alias("nr_latitude"), comma("lon").alias("LNG")).join(kinds, "id")
    dim = v.zone_dim()
    layer = F.when(F.col("region") == "ASIA", "CAPITAL").when(F.col("region") == "EUROPE", "RMF").otherwise("INTERIOR")
    zones = dim.select(F.col("zone").alias("poly"), F.col("zone_name").alias("zone"), layer.alias("layer"))
    last = keep_first(v.snapshot(), ["zone"], [F.col("date").desc()]).filter(F.col("label") != "view")
    labels = last.join(dim.select(F.col("zone").cast("bigint").alias("zone"), "zone_name"), "zone").select(F.col("zone_name").alias("zone"), "label")
    fact = consolidate.consolidated_events(raw, "id", v.polygon(), zones, labels)
    path = scratch_path(v.spark, "fact")
    write_partitioned(fact.select("id", "zone", "layer", "kind", "label"), path, ["layer"], files_per_partition=4)
    return v.spark.read.parquet(path)


_ZD = "OVER (PARTITION BY zone ORDER BY date"


@query(
    "flow_feature_panel",
    with_sql(
        "ev panel",
        "SELECT zone, date, n, click_norm, view_norm, least(click_norm * 0.4 + view_norm * 0.3 + purchase_norm * 0.3, 1) AS intensity, "
        f"CAST(lag(click_norm, 7, 0) {_ZD}) AS DOUBLE) AS click_norm_lag7, avg(view_norm) {_ZD} ROWS 29 PRECEDING) AS view_norm_ma30, coalesce(stddev_samp(purchase_norm) {_ZD} ROWS 6 PRECEDING), 0) AS purchase_norm_vol7, sin(2 * pi() * (isodow(date) - 1) / 7) AS dow_sin FROM "
        "(SELECT *, " + ", ".join(f"least({c} / (SELECT quantile_cont(CASE WHEN kind = '{c}' THEN amount ELSE 0 END, 0.99) FROM ev), 1) AS {c}_norm" for c in AMOUNTS) + " FROM panel)",
        "click_norm view_norm intensity click_norm_lag7 view_norm_ma30 purchase_norm_vol7 dow_sin",
    ),
)
def _(v):
    amounts = {a: F.when(F.col("kind") == a, F.col("amount")).otherwise(0.0) for a in AMOUNTS}
    events = v.event().select("zone", "date", *[e.alias(a) for a, e in amounts.items()])
    f = consolidate.feature_panel(events, "zone", "date", AMOUNTS)
    return f.select("zone", "date", "n", "click_norm", "view_norm", "intensity", "click_norm_lag7", "view_norm_ma30", "purchase_norm_vol7", "dow_sin")


@query(
    "flow_seasonality_report",
    with_sql(
        "ev",
        "SELECT part, value, count(*) AS zones, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY part) AS pct FROM (SELECT part, zone, value, row_number() OVER (PARTITION BY part, zone ORDER BY count(*) DESC, value) AS rn FROM "
        "(SELECT zone, 'hour' AS part, hour AS value FROM ev UNION ALL SELECT zone, 'weekday', CAST(isodow(date) - 1 AS INTEGER) FROM ev) GROUP BY 1, 2, 3) WHERE rn = 1 GROUP BY 1, 2",
        "pct",
    ),
)
def _(v):
    # counts of all parts from one scan, then peaks and how many zones share them
    e = v.event().select("zone", F.weekday("date").alias("weekday"), "hour")
    counts = agg.season_counts(e, ["zone"], {"weekday": ["weekday"], "hour": ["hour"]})
    long = counts.select("zone", "part", F.coalesce("weekday", "hour").alias("value"), "n")
    peak = agg.peaks(long, ["part", "zone"], "value", "n")
    zones = peak.groupBy("part", "value").agg(F.count(F.lit(1)).alias("zones"))
    return agg.share_within(zones, ["part"], "zones", "pct").withColumn("pct", F.col("pct") * 100)
