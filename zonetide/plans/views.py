"""The driver tables seen as events, panels, series, points and polygons.

Every view exists twice: as a DataFrame and as a SQL fragment for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.operators.panel import bounds, densify
from zonetide.operators.ranking import keep_first
from zonetide.operators.windows import label_changes
from zonetide.session import cut_lineage

AMOUNTS = ["click", "view", "purchase"]
SNAPSHOT_STEP = 10  # days between snapshots


class Views:
    """Named views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def event(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("user_id").alias("zone"), F.to_date("ts").alias("date"), "ts", F.hour("ts").alias("hour"),
            F.col("event_type").alias("kind"), F.col("value").alias("amount"), "props",
        )

    def daily_zone(self) -> DataFrame:
        sums = [F.sum(F.when(F.col("kind") == k, F.col("amount")).otherwise(0.0)).alias(k) for k in AMOUNTS]
        return self.event().groupBy("zone", "date").agg(F.count(F.lit(1)).alias("n"), *sums)

    def panel(self) -> DataFrame:
        return densify(self.daily_zone(), "zone", "date", ["n", *AMOUNTS])

    def outcome_m(self) -> DataFrame:
        """Urgent orders per nation and month; counted per customer first, so
        the join moves counts and a hot customer is one row per month."""
        per = (
            self.table("orders").filter(F.col("o_orderpriority") == "1-URGENT")
            .groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("_n"))
        )
        return per.join(self.customer_zone(), "o_custkey").groupBy("zone", "month").agg(F.sum("_n").alias("y"))

    def treat_m(self) -> DataFrame:
        """Returned lines per nation and month, counted per supplier first."""
        per = (
            self.table("lineitem").filter(F.col("l_returnflag") == "R")
            .groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("_n"))
        )
        supp = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("zone"))
        return per.join(supp, "l_suppkey").groupBy("zone", "month").agg(F.sum("_n").alias("x"))

    def pairs_m(self) -> DataFrame:
        return self.treat_m().join(self.outcome_m(), ["zone", "month"])

    def outcome_daily(self) -> DataFrame:
        """Urgent orders per nation and day, counted per customer first."""
        per = (
            self.table("orders").filter(F.col("o_orderpriority") == "1-URGENT")
            .groupBy("o_custkey", F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("_n"))
        )
        return per.join(self.customer_zone(), "o_custkey").groupBy("zone", "date").agg(F.sum("_n").alias("n"))

    def panel_table(self) -> DataFrame:
        """The panel written once, for plans that read it several times."""
        return cut_lineage(self.panel(), "panel")

    def customer_zone(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("zone"))

    def order_counts(self, label: str, where: Column | None = None) -> DataFrame:
        """Orders per nation and value of one column, counted per customer first."""
        orders = self.table("orders") if where is None else self.table("orders").filter(where)
        per = orders.groupBy("o_custkey", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("_n"))
        return per.join(self.customer_zone(), "o_custkey").groupBy("zone", "label").agg(F.sum("_n").alias("n"))

    def order_days(self) -> DataFrame:
        """Orders per nation and day, counted per customer first."""
        per = self.table("orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("_n"))
        return per.join(self.customer_zone(), "o_custkey").groupBy("zone", "date").agg(F.sum("_n").alias("n"))

    def daily(self) -> DataFrame:
        return self.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
        )

    def zone_dim(self) -> DataFrame:
        r = self.table("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
        return self.table("nation").join(r, "n_regionkey").select(
            F.col("n_nationkey").alias("zone"), F.col("n_name").alias("zone_name"), "region"
        )

    def point(self) -> DataFrame:
        e = F.col("embedding")
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), (e[0].cast("double") - 40).alias("lon"), (e[1].cast("double") - 5).alias("lat")
        )

    def _with_box(self, df: DataFrame) -> DataFrame:
        """Add the bounding box of the points; the generator keeps the scalar
        from being planned again for every use of a corner."""
        ends = [f(c).alias(n) for n, f, c in [("x0", F.min, "lon"), ("x1", F.max, "lon"), ("y0", F.min, "lat"), ("y1", F.max, "lat")]]
        box = self.point().agg(*ends).select(F.struct("x0", "x1", "y0", "y1")).scalar()
        return df.withColumn("_box", F.explode(F.array(box))).select(*df.columns, "_box.*")

    def polygon(self) -> DataFrame:
        """A 5 x 5 lattice over the points with shifted, shared vertices."""
        base = self._with_box(self.table("nation").select(F.col("n_nationkey").alias("poly")))
        w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

        def corner(di: int, dj: int):
            i, j = F.col("poly") % 5 + di, F.floor(F.col("poly") / 5) + dj
            return F.struct(
                (F.col("x0") + w * i / 5.0 + (w / 5.0) * 0.15 * F.sin((i * 7 + j * 3).cast("double"))).alias("x"),
                (F.col("y0") + h * j / 5.0 + (h / 5.0) * 0.15 * F.cos((i * 3 + j * 7).cast("double"))).alias("y"),
            )

        return base.select("poly", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))

    def label_polygon(self) -> DataFrame:
        """One slanted strip per region, the third one disputed."""
        base = self._with_box(self.table("region").select(
            F.when(F.col("r_regionkey") == 2, "DISPUTA").otherwise(F.col("r_name")).alias("label"), F.col("r_regionkey").alias("r")
        ))
        w = F.col("x1") - F.col("x0")

        def corner(step: int, lean: float, y: str):
            return F.struct((F.col("x0") + w * (F.col("r") + step) / 5.0 + w * lean).alias("x"), F.col(y).alias("y"))

        return base.select("label", F.array(corner(0, 0.1, "y0"), corner(1, 0.1, "y0"), corner(1, -0.1, "y1"), corner(0, -0.1, "y1")).alias("ring"))

    def snapshot(self) -> DataFrame:
        """Most frequent kind so far, per zone and snapshot day.

        Snapshots follow each other from the first event on until one covers the last;
        events are counted per day before they are spread over snapshots.
        """
        events = self.event()
        low, high = bounds(events)
        days = F.sequence(F.date_add(low, SNAPSHOT_STEP - 1), F.date_add(high, SNAPSHOT_STEP - 1), F.expr(f"INTERVAL {SNAPSHOT_STEP} DAY"))
        daily = events.groupBy("zone", "date", "kind").agg(F.count(F.lit(1)).alias("_c"))
        rows = daily.withColumn("_days", days).select("zone", "kind", "_c", F.explode(F.filter("_days", lambda d: d >= F.col("date"))).alias("date"))
        counts = rows.groupBy("zone", "date", "kind").agg(F.sum("_c").alias("_n"))
        return keep_first(counts, ["zone", "date"], [F.col("_n").desc(), F.col("kind")]).select("zone", "date", F.col("kind").alias("label"))

    def label_set(self) -> DataFrame:
        """Kinds seen per zone and five-day period, as a sorted array."""
        period = F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(F.datediff("date", F.lit("2024-01-01").cast("date")) / 5) * 5).cast("int"))
        kinds = self.event().select("zone", period.alias("date"), "kind").distinct()
        return kinds.groupBy("zone", "date").agg(F.array_sort(F.collect_set("kind")).alias("labels"))

    def change_panel(self) -> DataFrame:
        """Dense panel with a flag on the days a new label set began."""
        flags = label_changes(self.label_set(), "zone", "date", "labels").select("zone", "date").distinct().withColumn("changed", F.lit(1))
        return self.panel().join(flags, ["zone", "date"], "left").na.fill(0, subset=["changed"]).select("zone", "date", "n", "changed")

    def prediction(self) -> DataFrame:
        """Daily means of the first 20 days (predicted) and the last 10 (actual)."""
        d = F.datediff("date", F.lit("2024-01-01").cast("date"))
        return self.panel().groupBy("zone").agg(
            F.avg(F.when(d < 20, F.col("n"))).alias("predicted"), F.avg(F.when(d >= 20, F.col("n"))).alias("actual"),
            F.coalesce(F.sum(F.when(d >= 20, F.col("n"))), F.lit(0)).alias("actions"),
        )

    def periods(self) -> DataFrame:
        """Counts per zone and five-day period over the dense panel."""
        p = F.floor(F.datediff("date", F.lit("2024-01-01").cast("date")) / 5).cast("int")
        return self.panel().groupBy("zone", p.alias("period")).agg(F.sum("n").alias("level"), F.sum("click").alias("click"))


# SQL twins.  name -> (fragments it needs, text)
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "ev AS (SELECT event_id, user_id AS zone, CAST(ts AS DATE) AS date, ts, CAST(hour(ts) AS INTEGER) AS hour, event_type AS kind, value AS amount, props FROM events)"),
    "dz": (("ev",), "dz AS (SELECT zone, date, count(*) AS n, sum(CASE WHEN kind = 'click' THEN amount ELSE 0 END) AS click, sum(CASE WHEN kind = 'view' THEN amount ELSE 0 END) AS view, sum(CASE WHEN kind = 'purchase' THEN amount ELSE 0 END) AS purchase FROM ev GROUP BY zone, date)"),
    "cal": (("dz",), "cal AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT min(date) AS lo, max(date) AS hi FROM dz))"),
    "panel": (("dz", "cal"), "panel AS (SELECT z.zone, c.date, coalesce(d.n, 0) AS n, coalesce(d.click, 0) AS click, coalesce(d.view, 0) AS view, coalesce(d.purchase, 0) AS purchase FROM (SELECT DISTINCT zone FROM dz) z CROSS JOIN cal c LEFT JOIN dz d ON d.zone = z.zone AND d.date = c.date)"),
    "om": ((), "om AS (SELECT c_nationkey AS zone, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)"),
    "tm": ((), "tm AS (SELECT s_nationkey AS zone, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY 1, 2)"),
    "pm": (("om", "tm"), "pm AS (SELECT tm.zone, tm.month, x, y FROM tm JOIN om ON tm.zone = om.zone AND tm.month = om.month)"),
    "oe": ((), "oe AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice AS amount, c_nationkey AS zone FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT')"),
    "daily": ((), "daily AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1)"),
    "zd": ((), "zd AS (SELECT n_nationkey AS zone, n_name AS zone_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"),
    "pt": ((), "pt AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) - 40 AS lon, CAST(embedding[2] AS DOUBLE) - 5 AS lat FROM embeddings)"),
    "box": (("pt",), "box AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM pt)"),
    "cor": (("box",), "cor AS (SELECT poly, pos, x0 + (x1 - x0) * i / 5.0 + ((x1 - x0) / 5.0) * 0.15 * sin(i * 7 + j * 3) AS x, y0 + (y1 - y0) * j / 5.0 + ((y1 - y0) / 5.0) * 0.15 * cos(i * 3 + j * 7) AS y FROM box, (SELECT n_nationkey AS poly, c.pos, n_nationkey % 5 + c.di AS i, n_nationkey // 5 + c.dj AS j FROM nation, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) c(pos, di, dj)))"),
    "edge": (("cor",), "edge AS (SELECT a.poly, a.pos, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM cor a JOIN cor b ON a.poly = b.poly AND b.pos = (a.pos + 1) % 4)"),
    "pip": (("pt", "edge"), "pip AS (SELECT pt.id, e.poly FROM pt, edge e GROUP BY pt.id, e.poly HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1)"),
    "cen": (("edge",), "cen AS (SELECT poly, any_value(gx) + sum((x1 + x2 - 2 * gx) * w) / (3 * sum(w)) AS x, any_value(gy) + sum((y1 + y2 - 2 * gy) * w) / (3 * sum(w)) AS y FROM (SELECT e.*, c.x AS gx, c.y AS gy, (x1 - c.x) * (y2 - c.y) - (x2 - c.x) * (y1 - c.y) AS w FROM edge e JOIN cor c ON c.poly = e.poly AND c.pos = 0) GROUP BY poly)"),
    "snap": (("ev",), "snap AS (SELECT zone, date, kind AS label FROM (SELECT zone, d.date, kind, row_number() OVER (PARTITION BY zone, d.date ORDER BY count(*) DESC, kind) AS rn FROM ev JOIN (SELECT CAST(unnest(generate_series(lo + 9, hi + 9, INTERVAL 10 DAY)) AS DATE) AS date FROM (SELECT min(date) AS lo, max(date) AS hi FROM ev)) d ON ev.date <= d.date GROUP BY zone, d.date, kind) WHERE rn = 1)"),
    "lset": (("ev",), "lset AS (SELECT zone, DATE '2024-01-01' + CAST(((date - DATE '2024-01-01') // 5) * 5 AS INTEGER) AS date, list_sort(list(DISTINCT kind)) AS labels FROM ev GROUP BY 1, 2)"),
    "chg": (("lset",), "chg AS (SELECT zone, date, old, labels FROM (SELECT zone, date, labels, lag(labels) OVER (PARTITION BY zone ORDER BY date) AS old FROM lset) WHERE old IS NOT NULL AND old <> labels)"),
    "newl": (("chg",), "newl AS (SELECT zone, date, old[1] AS old_label, unnest(list_filter(labels, lambda x: NOT list_contains(old, x))) AS new_label FROM chg)"),
    "cp": (("panel", "newl"), "cp AS (SELECT p.zone, p.date, p.n, CASE WHEN f.zone IS NULL THEN 0 ELSE 1 END AS changed FROM panel p LEFT JOIN (SELECT DISTINCT zone, date FROM newl) f ON f.zone = p.zone AND f.date = p.date)"),
    "pred": (("panel",), "pred AS (SELECT zone, avg(CASE WHEN date - DATE '2024-01-01' < 20 THEN n END) AS predicted, avg(CASE WHEN date - DATE '2024-01-01' >= 20 THEN n END) AS actual, CAST(coalesce(sum(CASE WHEN date - DATE '2024-01-01' >= 20 THEN n END), 0) AS BIGINT) AS actions FROM panel GROUP BY zone)"),
    "per": (("panel",), "per AS (SELECT zone, CAST((date - DATE '2024-01-01') // 5 AS INTEGER) AS period, CAST(sum(n) AS BIGINT) AS level, sum(click) AS click FROM panel GROUP BY 1, 2)"),
}


def with_sql(needs: str, body: str, rnd: str = "", extra: str = "") -> str:
    """A query over named fragments and ``extra`` ones given as text, with the
    listed columns rounded."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in FRAGMENTS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    if rnd:
        replaced = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in rnd.split())
        body = f"SELECT * REPLACE ({replaced}) FROM ({body})"
    parts = [FRAGMENTS[n][1] for n in order] + ([extra.strip()] if extra else [])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def best_names(least: float) -> str:
    """Fragments ``nm`` to ``m`` in SQL: for each name of ``raw`` the best of ``off`` (column o) by the ratio of matching blocks.

    A block is the longest common run of two segments, the first in the name, then the
    first in the listed one; the parts left and right of it are segments again.
    """
    run = "instr(substr(b, blo + 1, bhi - blo), substr(a, i + 1, l))"
    block = f"list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(1, ahi - i + 1), lambda l: CASE WHEN {run} > 0 THEN {{'s': l, 'i': -i, 'j': 1 - blo - {run}}} END))))"
    return (
        "nm AS (SELECT DISTINCT name, upper(trim(name)) AS a FROM raw), pr AS (SELECT DISTINCT a, o AS b FROM nm CROSS JOIN off), "
        "seg AS (SELECT a, b, CAST(0 AS BIGINT) AS alo, length(a) AS ahi, CAST(0 AS BIGINT) AS blo, length(b) AS bhi, CAST(0 AS BIGINT) AS m FROM pr UNION ALL "
        "SELECT a, b, part.alo, part.ahi, part.blo, part.bhi, part.m FROM (SELECT a, b, unnest([{'alo': alo, 'ahi': -w.i, 'blo': blo, 'bhi': -w.j, 'm': w.s}, {'alo': w.s - w.i, 'ahi': ahi, 'blo': w.s - w.j, 'bhi': bhi, 'm': 0}]) AS part "
        f"FROM (SELECT *, {block} AS w FROM seg WHERE ahi > alo AND bhi > blo) WHERE w IS NOT NULL)), "
        "sc AS (SELECT a, b, 2.0 * sum(m) / (length(a) + length(b)) AS s FROM seg GROUP BY a, b), "
        f"m AS (SELECT name, w.o AS matched, -w.s AS score FROM (SELECT name, a FROM nm) LEFT JOIN (SELECT a AS aa, min({{'s': -s, 'o': b}}) AS w FROM sc WHERE s >= {least} GROUP BY a) ON aa = a) "
    )
