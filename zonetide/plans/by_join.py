"""J*, O*, U*: joins, top-k, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.functions.text import normal_key
from zonetide.operators import joins, ranking, windows
from zonetide.operators.names import names_in_text
from zonetide.operators.panel import bounds
from zonetide.operators.spatial import points_in_polygons
from zonetide.plans.registry import query
from zonetide.plans.views import with_sql

_WEEK = ["SEGUNDA", "TERCA", "QUARTA", "QUINTA", "SEXTA", "SABADO", "DOMINGO"]


@query("j1_lookup_with_default", with_sql("", "SELECT c_custkey, coalesce(n_name, 'SEM DADO') AS zone_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 1"))
def _(v):
    dim = v.table("nation").filter("n_regionkey <> 1").select(
        F.upper(F.concat(F.lit("k"), "n_nationkey")).alias("key"), normal_key(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).alias("zone_name")
    )
    rows = v.table("customer").select("c_custkey", F.upper(F.concat(F.lit("k"), "c_nationkey")).alias("key"))
    return joins.lookup(rows, dim, "key", "zone_name", "SEM DADO").drop("key")


@query("j2_two_series", with_sql("pm", "SELECT zone, month, x, y FROM pm"))
def _(v):
    return v.pairs_m()


@query("j3_semi_join", with_sql("om tm", "SELECT zone, month, x FROM tm WHERE EXISTS (SELECT 1 FROM om WHERE om.zone = tm.zone AND om.month = tm.month AND om.y >= 2)"))
def _(v):
    return v.treat_m().join(v.outcome_m().filter("y >= 2"), ["zone", "month"], "left_semi")


@query("j4_grid_zero_fill", with_sql("panel", "SELECT zone, date, n, click, view, purchase FROM panel", "click view purchase"))
def _(v):
    return v.panel()


@query("j5_map_lookup", with_sql("zd", "SELECT s_suppkey, zone_name, region FROM supplier LEFT JOIN zd ON s_nationkey = zone"))
def _(v):
    dim = v.zone_dim().withColumnRenamed("zone", "s_nationkey")
    return v.table("supplier").select("s_suppkey", "s_nationkey").join(dim, "s_nationkey", "left").drop("s_nationkey")


_TIERS = (
    "dim AS (SELECT c_mktsegment AS seg, c_nationkey AS zone, c_custkey % 3 AS prio, c_name AS value FROM customer WHERE c_acctbal > 9700), "
    "ex AS (SELECT seg, zone, value FROM (SELECT *, row_number() OVER (PARTITION BY seg, zone ORDER BY prio, value) AS rn FROM dim) WHERE rn = 1), "
    "lo AS (SELECT zone, value FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY prio, seg, value) AS rn FROM dim) WHERE rn = 1) "
)


@query(
    "j6_two_tier_lookup",
    "WITH " + _TIERS + "SELECT c.c_custkey, coalesce(ex.value, lo.value) AS value, CASE WHEN ex.value IS NOT NULL THEN 'exact' WHEN lo.value IS NOT NULL THEN 'loose' ELSE 'none' END AS tier "
    "FROM customer c LEFT JOIN ex ON ex.seg = c.c_mktsegment AND ex.zone = c.c_nationkey LEFT JOIN lo ON lo.zone = c.c_nationkey",
)
def _(v):
    c = v.table("customer")
    dim = c.filter("c_acctbal > 9700").select(
        F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("zone"), (F.col("c_custkey") % 3).alias("prio"), F.col("c_name").alias("value")
    )
    rows = c.select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("zone"))
    return joins.two_tier_lookup(rows, dim, "seg", "zone", "value", "prio").select("c_custkey", "value", "tier")


@query(
    "j7_blank_fallback",
    with_sql(
        "zd",
        "SELECT z.zone, CASE WHEN z.region = 'AFRICA' THEN '' ELSE z.region END AS region, CASE WHEN z.region = 'AFRICA' THEN (SELECT round(sum(c_acctbal), 2) FROM customer WHERE c_nationkey = z.zone) "
        "ELSE (SELECT round(sum(c_acctbal), 2) FROM customer JOIN zd k ON k.zone = c_nationkey WHERE c_nationkey = z.zone AND k.region = z.region) END AS total FROM zd z",
    ),
)
def _(v):
    dim = v.zone_dim()
    left = dim.select("zone", F.when(F.col("region") == "AFRICA", "").otherwise(F.col("region")).alias("region"))
    right = v.table("customer").select(F.col("c_nationkey").alias("zone"), F.col("c_acctbal").alias("total")).join(dim.select("zone", "region"), "zone")
    return joins.blank_fallback_counts(left, right, "region", "zone", "total").select("zone", "region", F.round("total", 2).alias("total"))


@query(
    "j8_cascade_assignment",
    with_sql(
        "pip zd",
        "SELECT id, layer, poly FROM (SELECT p.id, z.region AS layer, p.poly, row_number() OVER (PARTITION BY p.id ORDER BY CASE z.region WHEN 'ASIA' THEN 1 WHEN 'EUROPE' THEN 2 WHEN 'AFRICA' THEN 3 WHEN 'AMERICA' THEN 4 ELSE 5 END, p.poly) AS rn "
        "FROM pip p JOIN zd z ON z.zone = p.poly) WHERE rn = 1",
    ),
)
def _(v):
    hits = points_in_polygons(v.point(), v.polygon(), "poly", "ring", "lon", "lat", 0.05)
    layered = hits.join(v.zone_dim().select(F.col("zone").alias("poly"), F.col("region").alias("layer")), "poly")
    order = ["ASIA", "EUROPE", "AFRICA", "AMERICA", "MIDDLE EAST"]
    return joins.cascade(layered, "id", "layer", order, F.col("poly")).select("id", "layer", "poly")


@query(
    "j9_priority_dedup",
    with_sql(
        "",
        "SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    ),
)
def _(v):
    o = v.table("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return ranking.keep_first(o, ["c_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")]).select("c_custkey", "o_orderkey")


@query(
    "j10_period_neighbours",
    with_sql(
        "om",
        "SELECT a.zone, a.month, a.y, p.y AS y_prev, n.y AS y_next FROM om a LEFT JOIN om p ON p.zone = a.zone AND p.month = CAST(a.month - INTERVAL 1 MONTH AS DATE) "
        "LEFT JOIN om n ON n.zone = a.zone AND n.month = CAST(a.month + INTERVAL 1 MONTH AS DATE)",
    ),
)
def _(v):
    return joins.period_neighbours(v.outcome_m(), "zone", "month", "y", [-1, 1])


@query(
    "j11_trailing_window_join",
    with_sql("panel ev", "SELECT p.zone, p.date, count(e.event_id) AS trailing FROM panel p LEFT JOIN ev e ON e.zone = p.zone AND e.date >= p.date - 9 AND e.date < p.date GROUP BY 1, 2"),
)
def _(v):
    return windows.trailing_count(v.panel(), "zone", "date", "n", 9).select("zone", "date", "trailing")


@query("j12_as_of_snapshot", with_sql("panel snap", "SELECT p.zone, p.date, p.n, s.label FROM panel p ASOF LEFT JOIN snap s ON s.zone = p.zone AND s.date <= p.date"))
def _(v):
    return joins.as_of(v.panel().select("zone", "date", "n"), v.snapshot(), "zone", "date", "label")


@query("j12_exact_snapshot", with_sql("panel snap", "SELECT p.zone, p.date, p.n, s.label FROM panel p LEFT JOIN snap s ON s.zone = p.zone AND s.date = p.date"))
def _(v):
    return joins.as_of(v.panel().select("zone", "date", "n"), v.snapshot(), "zone", "date", "label", exact=True)


@query(
    "j13_name_in_text",
    'SELECT d.page_id, w.name AS found FROM pages d JOIN (SELECT DISTINCT upper(\'lang="\' || lang || \'"\') AS name FROM documents UNION SELECT DISTINCT upper(r_name) FROM region) w ON contains(upper(d.html), w.name)',
)
def _(v):
    names = v.table("documents").select(F.concat(F.lit('lang="'), "lang", F.lit('"')).alias("name")).unionByName(v.table("region").select(F.col("r_name").alias("name"))).distinct()
    return names_in_text(v.table("pages").select("page_id", "html"), "html", names, "name").select("page_id", "found")


_ZS = "zs AS (SELECT s_nationkey AS zone, avg(s_acctbal) / 100 AS score FROM supplier GROUP BY 1) "


@query("j14_pairs_within_score", "WITH " + _ZS + "SELECT a.zone AS a, b.zone AS b, round(a.score, 6) AS sa, round(b.score, 6) AS sb FROM zs a JOIN zs b ON a.zone < b.zone AND abs(a.score - b.score) < 7.0")
def _(v):
    scores = v.table("supplier").groupBy(F.col("s_nationkey").alias("zone")).agg((F.avg("s_acctbal") / 100).alias("score"))
    return joins.pairs_within_score(scores, "zone", "score", 7.0)


@query(
    "j15_node_left_joins",
    with_sql("pred ev", "SELECT p.zone, p.predicted, coalesce(o.n, 0) AS observed, coalesce(w.n, 0) AS without FROM pred p LEFT JOIN (SELECT zone, count(*) AS n FROM ev WHERE date > DATE '2024-01-25' GROUP BY 1) o ON o.zone = p.zone "
             "LEFT JOIN (SELECT zone, count(*) AS n FROM ev WHERE date > DATE '2024-01-25' AND kind <> 'error' GROUP BY 1) w ON w.zone = p.zone", "predicted"),
)
def _(v):
    recent = v.event().filter(F.col("date") > F.lit("2024-01-25").cast("date"))
    seen = recent.groupBy("zone").agg(F.count(F.lit(1)).alias("observed"), F.count_if(F.col("kind") != "error").alias("without"))
    return v.prediction().select("zone", "predicted").join(seen, "zone", "left").na.fill(0, subset=["observed", "without"])


@query("o1_top_k", with_sql("ev", "SELECT zone, count(*) AS n FROM ev GROUP BY zone ORDER BY n DESC, zone LIMIT 15"))
def _(v):
    counts = v.event().groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_k(counts, [F.col("n").desc(), F.col("zone")], 15)


@query(
    "o2_top_k_per_group",
    with_sql(
        "ev",
        "SELECT zone, hour, n, CAST(pos AS INTEGER) AS pos FROM (SELECT zone, hour, count(*) AS n, row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, hour) AS pos FROM ev "
        "WHERE zone IN (SELECT zone FROM ev GROUP BY zone ORDER BY count(*) DESC, zone LIMIT 20) GROUP BY zone, hour) WHERE pos <= 3",
    ),
)
def _(v):
    hours = v.event().groupBy("zone", "hour").agg(F.count(F.lit(1)).alias("n"))
    busiest = ranking.top_k(hours.groupBy("zone").agg(F.sum("n").alias("t")), [F.col("t").desc(), F.col("zone")], 20).select("zone")
    return ranking.top_k_per_group(hours.join(busiest, "zone", "left_semi"), ["zone"], [F.col("n").desc(), F.col("hour")], 3)


@query(
    "o3_custom_order",
    "SELECT weekday, n, CAST(list_position(['SEGUNDA','TERCA','QUARTA','QUINTA','SEXTA','SABADO','DOMINGO'], weekday) AS BIGINT) AS place FROM "
    "(SELECT (['SEGUNDA','TERCA','QUARTA','QUINTA','SEXTA','SABADO','DOMINGO'])[isodow(o_orderdate)] AS weekday, count(*) AS n FROM orders GROUP BY 1) ORDER BY place",
)
def _(v):
    name = F.element_at(F.array(*[F.lit(w) for w in _WEEK]), F.weekday("o_orderdate") + 1)
    counts = v.table("orders").groupBy(name.alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    return ranking.by_custom_order(counts, "weekday", _WEEK, F.col("n").desc())


@query(
    "o4_both_ends",
    with_sql("ev", "(SELECT zone, count(*) AS n, 'high' AS side FROM ev GROUP BY zone ORDER BY n DESC, zone LIMIT 20) UNION ALL (SELECT zone, count(*) AS n, 'low' AS side FROM ev GROUP BY zone ORDER BY n, zone LIMIT 20)"),
)
def _(v):
    return ranking.both_ends(v.event().groupBy("zone").agg(F.count(F.lit(1)).alias("n")), "n", "zone", 20)


@query("o5_sort_by_absolute", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 4500) DESC, c_custkey LIMIT 25")
def _(v):
    return ranking.top_k(v.table("customer").select("c_custkey", "c_acctbal"), [F.abs(F.col("c_acctbal") - 4500).desc(), F.col("c_custkey")], 25)


@query("o6_dedup_rows", "SELECT DISTINCT md5(text) AS digest, lang FROM documents")
def _(v):
    return v.table("documents").select(F.md5("text").alias("digest"), "lang").dropDuplicates()


@query("o6_dedup_keep_first", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY md5(text)")
def _(v):
    # an aggregate keeps the first id without moving any text
    return v.table("documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("u1_intersect", "SELECT c_nationkey AS zone FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(v):
    a = v.table("customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("zone"))
    return a.intersect(v.table("supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("u2_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(v):
    urgent = v.table("orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    return v.table("customer").select(F.col("c_custkey").alias("id")).subtract(urgent)


@query(
    "u3_union_with_source",
    "SELECT 'customer' AS source, c_nationkey AS zone, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier",
)
def _(v):
    a = v.table("customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("zone"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = v.table("supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("zone"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "u4_entered_left",
    with_sql(
        "ev",
        "SELECT coalesce(a.zone, b.zone) AS zone, CASE WHEN b.zone IS NULL THEN 'left' WHEN a.zone IS NULL THEN 'entered' ELSE 'kept' END AS status FROM "
        "(SELECT zone FROM ev GROUP BY zone ORDER BY count(*) DESC, zone LIMIT 20) a FULL JOIN (SELECT zone FROM ev WHERE date > (SELECT max(date) FROM ev) - 15 GROUP BY zone ORDER BY count(*) DESC, zone LIMIT 20) b ON a.zone = b.zone",
    ),
)
def _(v):
    e = v.event().select("zone", "date")
    _, last = bounds(e)
    top = lambda d: ranking.top_k(d.groupBy("zone").agg(F.count(F.lit(1)).alias("n")), [F.col("n").desc(), F.col("zone")], 20)
    return ranking.compare_lists(top(e), top(e.filter(F.col("date") > F.date_sub(last, 15))), "zone")


@query("u5_remainder", "SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(v):
    return v.table("documents").select("doc_id", "source").join(v.table("labels").select("doc_id"), "doc_id", "left_anti")


