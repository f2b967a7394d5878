"""P* and F*: column expressions, classifiers, scores and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonetide.functions import dates, geo, ladders, numbers, text
from zonetide.operators.joins import flag_match
from zonetide.operators.matching import narrative_fields, structured_narrative_fields
from zonetide.operators.panel import bounds
from zonetide.operators.ranking import column_quantiles
from zonetide.operators.rules import effective_start
from zonetide.operators.spatial import in_box
from zonetide.plans.registry import query
from zonetide.plans.views import with_sql
from zonetide.sources.files import detect_columns, prediction_columns, rename_aliases


@query("p1_parse_number", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS amount FROM events")
def _(v):
    raw = F.when(F.col("event_type") == "error", "n/d").otherwise(F.regexp_replace(F.col("value").cast("string"), r"\.", ","))
    return v.table("events").select("event_id", numbers.parse_number(raw).alias("amount"))


@query("p2_rename_aliases", with_sql("pt", "SELECT id, lat, lon AS long FROM pt", "lat long"))
def _(v):
    raw = v.point().select(
        "id", F.when(F.col("id") % 2 == 0, F.col("lat")).alias("Latitude"), F.when(F.col("id") % 2 == 1, F.col("lat")).alias("nr_latitude"), F.col("lon").alias("LNG")
    )
    return rename_aliases(raw)


@query("p2_prediction_columns", "SELECT upper(c_name) AS zone, c_acctbal AS risk FROM customer")
def _(v):
    raw = v.table("customer").select(F.concat(F.lit(" "), "c_name").alias("bairro"), "c_custkey", F.col("c_acctbal").cast("string").alias("Risco_30d"))
    return prediction_columns(raw)


@query("p3_detect_columns", with_sql("pt", "SELECT id, lat, lon FROM pt", "lat lon"))
def _(v):
    raw = v.point().select("id", F.col("lat").alias("GEO_LATITUDE"), F.col("lon").alias("lng_wgs"))
    found = detect_columns(raw.columns)
    return raw.select("id", F.col(found["lat"]).alias("lat"), F.col(found["lon"]).alias("lon"))


@query(
    "p4_parse_moment",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS moment FROM events",
)
def _(v):
    day = F.when(F.col("event_type") == "error", "31-31-31").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    time = F.when(F.col("event_type") != "view", F.date_format("ts", "HH:mm:ss"))
    return v.table("events").select("event_id", dates.parse_moment(day, time).alias("moment"))


@query(
    "p5_date_parts",
    "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, "
    "(['Segunda','Terça','Quarta','Quinta','Sexta','Sábado','Domingo'])[isodow(ts)] AS weekday_name, "
    "(['Janeiro','Fevereiro','Março','Abril','Maio','Junho','Julho','Agosto','Setembro','Outubro','Novembro','Dezembro'])[month(ts)] AS month_name FROM events",
)
def _(v):
    return v.table("events").select(
        "event_id", F.year("ts").alias("year"), F.month("ts").alias("month"), F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"),
        dates.weekday_name("ts").alias("weekday_name"), dates.month_name("ts").alias("month_name"),
    )


@query(
    "p6_period_arithmetic",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS year_month, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, "
    "CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS prev_month, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_month, "
    "CAST(date_trunc('month', o_orderdate) - INTERVAL 12 MONTH AS DATE) AS prev_year, CAST(date_trunc('year', o_orderdate) AS DATE) AS year_start FROM orders",
)
def _(v):
    m = dates.month_of("o_orderdate")
    return v.table("orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("year_month"), m.alias("month"), F.add_months(m, -1).alias("prev_month"),
        F.add_months(m, 1).alias("next_month"), F.add_months(m, -12).alias("prev_year"), F.trunc("o_orderdate", "year").alias("year_start"),
    )


@query(
    "p7_normal_key",
    "SELECT p_partkey, upper(trim(regexp_replace('  ' || p_name || '   x ', '\\s+', ' ', 'g'))) AS key, "
    "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part",
)
def _(v):
    dirty = F.concat(F.lit("  "), "p_name", F.lit("   x "))
    return v.table("part").select("p_partkey", text.normal_key(dirty).alias("key"), text.title_key(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "))).alias("title"))


@query("p8_strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.md5(text.plain_latin("text")).alias("plain"))


@query("p8_strip_marks_any_script", "SELECT conv_id, turn, md5(strip_accents(text)) AS plain FROM conversations")
def _(v):
    return v.table("conversations").select("conv_id", "turn", F.md5(text.strip_marks("text")).alias("plain"))


_WORDS = ["license", "copyright", "password", "warranty"]


@query(
    "p9_keyword_class",
    "SELECT lang, CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') OR contains(lower(text), 'password') OR contains(lower(text), 'warranty') "
    "THEN 'legal' ELSE 'other' END AS class, count(*) AS n FROM documents GROUP BY 1, 2",
)
def _(v):
    flag = text.any_word(F.lower("text"), _WORDS)
    return v.table("documents").select("lang", F.when(flag, "legal").otherwise("other").alias("class")).groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n"))


@query("p9_event_class", with_sql("ev", "SELECT event_id, CASE WHEN kind IN ('error', 'purchase') THEN 'A' ELSE 'B' END AS class FROM ev"))
def _(v):
    flag = text.any_word(F.upper("kind"), ["ERR", "PURCH"])
    return v.event().select("event_id", F.when(flag, "A").otherwise("B").alias("class"))


@query(
    "p10_any_column_keyword",
    "SELECT page_id, (contains(lower(url), 'ref=') OR contains(lower(html), 'ref=') OR contains(lower(url), 'nofollow') OR contains(lower(html), 'nofollow')) AS flagged FROM pages",
)
def _(v):
    pages = v.table("pages")
    return pages.select("page_id", text.any_column_has(["url", "html"], ["ref=", "nofollow"]).alias("flagged"))


@query("p11_first_of", "SELECT p_partkey, nullif(regexp_extract(upper(p_name), '(RING|WIDGET|BOLT)', 1), '') AS category FROM part")
def _(v):
    return v.table("part").select("p_partkey", text.first_of(F.upper("p_name"), ["RING", "WIDGET", "BOLT"]).alias("category"))


@query(
    "p12_parse_lat_lon",
    with_sql("pt", "SELECT id, CASE WHEN id % 5 <> 0 THEN lat END AS lat, CASE WHEN id % 5 <> 0 THEN lon END AS lon FROM pt", "lat lon"),
)
def _(v):
    # every fifth text is out of range and must come back empty
    lat = F.when(F.col("id") % 5 == 0, F.col("lat") + 200).otherwise(F.col("lat"))
    raw = v.point().withColumn("raw", F.concat(F.lit("["), lat.cast("string"), F.lit(", "), F.col("lon").cast("string"), F.lit("]")))
    la, lo = geo.parse_lat_lon("raw")
    return raw.select("id", la.alias("lat"), lo.alias("lon"))


def _dms(c: str):
    a = F.abs(F.col(c))
    deg = F.floor(a)
    minute = F.floor((a - deg) * 60)
    second = F.round(((a - deg) * 60 - minute) * 60, 1)
    return F.concat(deg.cast("string"), F.lit("°"), minute.cast("string"), F.lit("'"), second.cast("string"), F.lit('"'))


_SQL_DMS = "-(floor(abs({c})) + floor((abs({c}) - floor(abs({c}))) * 60) / 60 + round(((abs({c}) - floor(abs({c}))) * 60 - floor((abs({c}) - floor(abs({c}))) * 60)) * 60, 1) / 3600)"


@query(
    "p13_parse_dms",
    with_sql("pt", f"SELECT id, CASE WHEN id % 2 = 0 THEN {_SQL_DMS.format(c='lat')} ELSE lat END AS lat, CASE WHEN id % 2 = 0 THEN {_SQL_DMS.format(c='lon')} ELSE lon END AS lon FROM pt", "lat lon"),
)
def _(v):
    dms = F.concat(_dms("lat"), F.lit("S,"), _dms("lon"), F.lit("W"))
    plain = F.concat(F.col("lat").cast("string"), F.lit(","), F.col("lon").cast("string"))
    raw = v.point().withColumn("raw", F.when(F.col("id") % 2 == 0, dms).otherwise(plain))
    la, lo = geo.parse_coordinates("raw")
    return raw.select("id", la.alias("lat"), lo.alias("lon"))


@query(
    "p14_narrative_fields",
    with_sql(
        "ev",
        "SELECT event_id, CAST(1 + hour AS INTEGER) AS people, CASE WHEN kind = 'view' THEN 0.0 WHEN kind = 'error' THEN amount ELSE amount * 1000 END AS grams, "
        "CASE WHEN kind = 'click' THEN 0 ELSE CAST(2 + hour AS INTEGER) END AS weapons, "
        "CASE kind WHEN 'purchase' THEN 'megaoperacao' WHEN 'signup' THEN 'patrulhamento' ELSE 'operacao_rotina' END AS kind, "
        "(1 + CASE WHEN kind = 'view' THEN 0 ELSE 1 END + CASE WHEN kind = 'click' THEN 0 ELSE 1 END) / 4.0 AS score FROM ev",
        "grams score",
    ),
)
def _(v):
    kind = F.col("kind")
    mass = F.when(kind == "view", "").when(kind == "error", F.concat(F.col("amount").cast("string"), F.lit("g de drogas"))).otherwise(
        F.concat(F.col("amount").cast("string"), F.lit(" kg de Maconha"))
    )
    guns = F.when(kind == "click", "").otherwise(F.concat((F.col("hour") + 2).cast("string"), F.lit(" pistolas")))
    action = F.when(kind == "purchase", "Megaoperação:").when(kind == "signup", "Patrulhamento:").otherwise("Rotina:")
    rows = v.event().withColumn("story", F.concat_ws(" ", action, F.concat((F.col("hour") + 1).cast("string"), F.lit(" presos")), guns, mass))
    return narrative_fields(rows.drop("kind"), "story").select("event_id", "people", "grams", "weapons", "kind", "score")


@query(
    "p14_narrative_degrees",
    with_sql(
        "ev",
        "SELECT event_id, CAST(CASE kind WHEN 'view' THEN -3 + hour / 60.0 + 30 / 3600.0 WHEN 'click' THEN -3.5 END AS DOUBLE) AS lat, CAST(CASE kind WHEN 'view' THEN -38 + 15 / 60.0 + hour / 3600.0 WHEN 'click' THEN -38.25 END AS DOUBLE) AS lon, CAST(CASE WHEN kind IN ('view', 'click') THEN 0.25 ELSE 0 END AS DOUBLE) AS score FROM ev",
        "lat lon score",
    ),
)
def _(v):
    """Degrees, minutes and seconds in the text; minutes and seconds add to the signed degrees."""
    place = (
        F.when(F.col("kind") == "view", F.format_string("em -3°%d'30\",-38°15'%d\"", "hour", "hour"))
        .when(F.col("kind") == "click", "em -3.5, -38.25 hoje").otherwise("em casa")
    )
    fields = narrative_fields(v.event().select("event_id", place.alias("story")), "story")
    return fields.select("event_id", "lat", "lon", "score")


@query(
    "p14_structured_branches",
    with_sql(
        "ev",
        "SELECT event_id, CAST(CASE kind WHEN 'click' THEN hour + 1.0 WHEN 'view' THEN (hour + 1) * 10.0 WHEN 'purchase' THEN hour + 1.5 + 7 ELSE 0 END AS DOUBLE) AS grams, CAST(CASE kind WHEN 'click' THEN hour + 2 WHEN 'view' THEN 1 ELSE 0 END AS INTEGER) AS weapons, "
        "CASE kind WHEN 'click' THEN 'Artigo ' || CAST(hour + 30 AS VARCHAR) WHEN 'view' THEN CAST(hour + 30 AS VARCHAR) || ' - posse' WHEN 'purchase' THEN 'Artigo 33' ELSE 'Operação Tropa' END AS nature FROM ev",
        "grams",
    ),
)
def _(v):
    """Lower-case accents, the named mass fields, and the bounds of the nature field with its fallback."""
    h = lambda n: (F.col("hour") + n).cast("string")
    story = (
        F.when(F.col("kind") == "click", F.concat(F.lit("10 - natureza da ocorrência: "), h(30), F.lit(" - tráfico\n11 - "), h(2), F.lit(" revólver e "), h(1), F.lit(" g de cocaína")))
        .when(F.col("kind") == "view", F.concat(F.lit("10 - NATUREZA: "), h(30), F.lit(" - posse\nfim, uma pistola\nCOCAÍNA (PESO EM GRAMA): "), h(1), F.lit(" PAPELOTES")))
        .when(F.col("kind") == "purchase", F.concat(F.lit("MACONHA (PESO EM GRAMAS): "), h(1), F.lit(".5G, 7 PAPELOTES\n10 - NATUREZA: 33")))
        .otherwise("nada")
    )
    rows = v.event().select("event_id", story.alias("story"), F.lit("2024-01-01").alias("registered"), F.lit("").alias("la"), F.lit("").alias("lo"))
    return structured_narrative_fields(rows, "story", "registered", "la", "lo").select("event_id", "grams", "weapons", "nature")


@query(
    "p14_structured_narrative",
    with_sql(
        "ev",
        "SELECT event_id, date, 'CIDADE ' || upper(kind) AS place, 'Artigo ' || CAST(100 + hour AS VARCHAR) AS nature, CASE WHEN kind = 'view' THEN 0.0 ELSE amount + 2.5 END AS grams, "
        "CAST(hour + 1 AS INTEGER) AS weapons, (CASE WHEN kind = 'view' THEN 0 ELSE 1 END + 1 + 1) / 3.0 AS score FROM ev",
        "grams score",
    ),
)
def _(v):
    mass = F.when(F.col("kind") == "view", "NADA").otherwise(
        F.concat(F.col("amount").cast("string"), F.lit("G DE MACONHA E 2.5 G DE CRACK"))
    )
    registered = F.when(F.col("hour") % 2 == 0, F.date_format("date", "yyyy-MM-dd")).otherwise("2020-01-01")
    head = F.when(F.col("hour") % 2 == 0, "").otherwise(F.concat(F.lit("01 - DATA: "), F.date_format("date", "d/M/yyyy")))
    story = F.concat_ws(
        "\n", head, F.concat(F.lit("02 - MUNICÍPIO: CIDADE "), F.upper("kind"), F.lit("-CE")),
        F.concat(F.lit("10 - NATUREZA DA OCORRÊNCIA: "), (F.col("hour") + 100).cast("string"), F.lit(" - X")),
        F.concat(F.lit("11 - MATERIAL: "), mass), F.concat(F.lit("12 - ARMAS: "), F.col("hour").cast("string"), F.lit(" PISTOLA, UM FUZIL")),
    )
    rows = v.event().select("event_id", story.alias("story"), registered.alias("registered"), F.lit("-3.7").alias("latitude"), F.lit("-38.5").alias("longitude"))
    return structured_narrative_fields(rows, "story", "registered", "latitude", "longitude").select(
        "event_id", "date", "place", "nature", "grams", "weapons", "score"
    )


@query("p15_derived_flags", with_sql("dz", "SELECT zone, date, click >= 100 AS heavy, click > 0 AND view > 0 AS both_kinds FROM dz"))
def _(v):
    return v.daily_zone().select("zone", "date", (F.col("click") >= 100).alias("heavy"), ((F.col("click") > 0) & (F.col("view") > 0)).alias("both_kinds"))


_CAP = "least(greatest({c} / (SELECT quantile_cont({c}, 0.99) FROM panel), 0), 1)"


@query("p16_cap_scale", with_sql("panel", f"SELECT zone, date, {_CAP.format(c='click')} AS click_norm, {_CAP.format(c='view')} AS view_norm FROM panel", "click_norm view_norm"))
def _(v):
    p = v.panel_table()
    caps = column_quantiles(p, {c: (c, 0.99) for c in ("click", "view")})
    return p.select("zone", "date", *[numbers.cap_scale(F.col(c), cap).alias(c + "_norm") for c, cap in caps.items()])


@query(
    "p17_intensity",
    with_sql("panel", f"SELECT zone, date, least(greatest({_CAP.format(c='n')} * 0.4 + {_CAP.format(c='click')} * 0.3 + {_CAP.format(c='view')} * 0.3, 0), 1) AS intensity FROM panel", "intensity"),
)
def _(v):
    p = v.panel_table()
    caps = column_quantiles(p, {c: (c, 0.99) for c in ("n", "click", "view")})
    scaled = [numbers.cap_scale(F.col(c), cap) for c, cap in caps.items()]
    return p.select("zone", "date", numbers.intensity(*scaled).alias("intensity"))


@query(
    "p18_rule_score",
    with_sql("dz", "SELECT zone, date, 3 * (CASE WHEN purchase > 0 THEN 1 ELSE 0 END) + 2 * least(click / 100, 10) + 2 * (CASE WHEN click > 0 AND view > 0 THEN 1 ELSE 0 END) + 0.1 * n AS score FROM dz", "score"),
)
def _(v):
    both = (F.col("click") > 0) & (F.col("view") > 0)
    return v.daily_zone().select("zone", "date", numbers.rule_score(F.col("purchase") > 0, F.col("click") / 100, both, F.col("n")).alias("score"))


@query(
    "p19_cyclic",
    with_sql(
        "",
        "SELECT o_orderkey, sin(2 * pi() * (isodow(o_orderdate) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(o_orderdate) - 1) / 7) AS dow_cos, "
        "sin(2 * pi() * month(o_orderdate) / 12) AS month_sin, cos(2 * pi() * month(o_orderdate) / 12) AS month_cos FROM orders",
        "dow_sin dow_cos month_sin month_cos",
    ),
)
def _(v):
    return v.table("orders").select("o_orderkey", *[e.alias(n) for n, e in dates.cyclic("o_orderdate").items()])


@query(
    "p20_one_hot",
    with_sql("ev", "SELECT d.zone, d.date, 'is_kind_' || k.kind AS flag, CAST(h.kind IS NOT NULL AS INTEGER) AS value FROM (SELECT DISTINCT zone, date FROM ev) d CROSS JOIN (SELECT DISTINCT kind FROM ev) k LEFT JOIN (SELECT DISTINCT zone, date, kind FROM ev) h ON h.zone = d.zone AND h.date = d.date AND h.kind = k.kind"),
)
def _(v):
    """One flag per kind that occurs, turned into rows for the check."""
    wide = v.event().withColumn("k", F.concat(F.lit("is_kind_"), "kind")).groupBy("zone", "date").pivot("k").agg(F.max(F.lit(1))).na.fill(0)
    return wide.unpivot(["zone", "date"], wide.columns[2:], "flag", "value")


@query(
    "p21_fixed_holidays",
    "SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%m-%d') IN ('01-01','05-01','09-07','10-12','11-02','11-15','12-25') THEN 1 ELSE 0 END AS holiday FROM orders",
)
def _(v):
    return v.table("orders").select("o_orderkey", dates.is_fixed_holiday("o_orderdate").alias("holiday"))


@query(
    "p21_listed_days",
    with_sql("daily", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) IN (SELECT date FROM daily WHERE n > (SELECT avg(n) FROM daily)) THEN 1 ELSE 0 END AS busy_day FROM orders"),
)
def _(v):
    daily = v.daily()
    days = daily.filter(F.col("n") > daily.select(F.avg("n")).scalar()).select("date")
    rows = v.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return flag_match(rows, days, "date", "busy_day").select("o_orderkey", "busy_day")


@query(
    "p22_step_ladders",
    with_sql(
        "ev",
        "SELECT event_id, CASE WHEN amount > 75 THEN 'CRITICO' WHEN amount > 50 THEN 'ALTO' WHEN amount > 25 THEN 'MEDIO' ELSE 'BAIXO' END AS score_class, "
        "CASE WHEN amount / 500 * f > 0.8 THEN 'CRITICO' WHEN amount / 500 * f > 0.5 THEN 'ALTO' WHEN amount / 500 * f > 0.2 THEN 'MEDIO' ELSE 'BAIXO' END AS alert, "
        "CASE WHEN amount >= 80 THEN 'CRITICO' WHEN amount >= 60 THEN 'ALTO' WHEN amount >= 40 THEN 'MEDIO' ELSE 'BAIXO' END AS share_class "
        "FROM (SELECT *, CASE WHEN kind = 'view' THEN 30.0 WHEN kind = 'click' THEN 6.0 ELSE 3.0 END AS f FROM ev)",
    ),
)
def _(v):
    region = F.when(F.col("kind") == "view", "INTERIOR").when(F.col("kind") == "click", "RMF").otherwise("CAPITAL")
    a = F.col("amount")
    return v.event().select(
        "event_id", ladders.ladder(a, ladders.SCORE_STEPS, "BAIXO").alias("score_class"), ladders.regional_alert(a / 500, region).alias("alert"),
        ladders.ladder(a, ladders.SHARE_STEPS, "BAIXO", inclusive=True).alias("share_class"),
    )


@query(
    "p23_cut_bins",
    "SELECT CASE WHEN l_quantity <= 10 THEN 'a' WHEN l_quantity <= 25 THEN 'b' ELSE 'c' END AS bin, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_quantity <= 50 GROUP BY 1",
)
def _(v):
    bins = ladders.cut(F.col("l_quantity"), [0, 10, 25, 50], ["a", "b", "c"])
    return v.table("lineitem").select(bins.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p24_event_weights",
    with_sql("ev", "SELECT event_id, CAST(CASE kind WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM ev WHERE date >= (SELECT max(date) FROM ev) - 10"),
)
def _(v):
    e = v.event()
    _, last = bounds(e.select("date"))
    weight = F.when(F.col("kind") == "purchase", 3.0).when(F.col("kind") == "error", 2.0).otherwise(1.0)
    return e.filter(F.col("date") >= F.date_sub(last, 10)).select("event_id", weight.alias("weight"))


@query("p25_pair_key", with_sql("zd", "SELECT zone, zone_name || ' / ' || region AS key, zone_name AS left_part, region AS right_part FROM zd"))
def _(v):
    rows = v.zone_dim().select("zone", text.pair_key("zone_name", "region").alias("key"))
    left, right = text.split_pair("key")
    return rows.select("zone", "key", left.alias("left_part"), right.alias("right_part"))


@query(
    "p26_percent_change",
    with_sql(
        "cp panel",
        "SELECT zone, date, CASE WHEN view > 0 THEN (click - view) * 100 / view END AS plain, "
        "CASE WHEN view > 0 THEN (click - view) * 100 / view WHEN click > 0 THEN 100 ELSE 0 END AS hundred, (click - view) * 100 / greatest(view, 1) AS unit FROM panel",
        "plain hundred unit",
    ),
)
def _(v):
    a, b = F.col("click"), F.col("view")
    return v.panel().select("zone", "date", *[numbers.percent_change(a, b, m).alias(n) for n, m in (("plain", "null"), ("hundred", "hundred"), ("unit", "unit"))])


@query(
    "p27_coalesce_with_source",
    "SELECT d.doc_id, coalesce('label_' || CAST(l.quality AS VARCHAR), d.source) AS value, CASE WHEN l.quality IS NOT NULL THEN 'label' WHEN d.source IS NOT NULL THEN 'original' ELSE 'none' END AS origin "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def _(v):
    rows = v.table("documents").select("doc_id", "source").join(v.table("labels").select("doc_id", "quality"), "doc_id", "left")
    first = F.concat(F.lit("label_"), F.col("quality").cast("string"))
    origin = F.when(first.isNotNull(), "label").when(F.col("source").isNotNull(), "original").otherwise("none")
    return rows.select("doc_id", F.coalesce(first, F.col("source")).alias("value"), origin.alias("origin"))


@query(
    "p29_destandardise",
    "SELECT event_id, round(greatest((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events) * 2 * (SELECT stddev_samp(value) FROM events) + (SELECT avg(value) FROM events), 0), 6) + 0.0 AS value FROM events",
)
def _(v):
    e = v.table("events").select("event_id", "value")
    mean, sd = e.select(F.avg("value")).scalar(), e.select(F.stddev_samp("value")).scalar()
    return e.select("event_id", numbers.destandardise((F.col("value") - mean) / sd * 2, mean, sd).alias("value"))


@query("f1_bounding_box", with_sql("pt", "SELECT id, lat, lon FROM pt WHERE lat > -5.1 AND lat < -4.9 AND lon > -40.1 AND lon < -39.9", "lat lon"))
def _(v):
    return in_box(v.point(), "lat", "lon", (-5.1, -4.9, -40.1, -39.9))


@query("f2_date_range", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-12-31'")
def _(v):
    # compared on the stored timestamp, so the range reaches the Parquet scan
    t = F.col("o_orderdate")
    start, after = F.lit("1996-02-01").cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz")
    return v.table("orders").filter((t >= start) & (t < after)).select("o_orderkey", F.to_date(t).alias("date"))


@query("f2_default_last_180_days", with_sql("daily", "SELECT date, n FROM daily WHERE date BETWEEN (SELECT max(date) FROM daily) - 180 AND (SELECT max(date) FROM daily)"))
def _(v):
    d = v.daily()
    _, last = bounds(v.table("orders").select(F.to_date("o_orderdate").alias("date")))
    return d.filter(F.col("date").between(F.date_sub(last, 180), last)).select("date", "n")


@query("f3_empty_window_fallback", with_sql("ev", "SELECT event_id, date FROM ev WHERE date BETWEEN DATE '2024-06-30' - 160 AND DATE '2024-06-30'"))
def _(v):
    e = v.event().select("event_id", "date")
    start, end = F.lit("2024-06-01").cast("date"), F.lit("2024-06-30").cast("date")
    return e.filter(F.col("date").between(effective_start(e, "date", start, end, 160), end))


@query("f4_region_kind_filter", with_sql("zd", "SELECT s_suppkey, zone_name FROM supplier JOIN zd ON s_nationkey = zone WHERE region IN ('ASIA', 'EUROPE') AND s_acctbal IS NOT NULL"))
def _(v):
    dim = v.zone_dim().filter(F.col("region").isin("ASIA", "EUROPE")).select(F.col("zone").alias("s_nationkey"), "zone_name")
    return v.table("supplier").filter(F.col("s_acctbal").isNotNull()).join(dim, "s_nationkey").select("s_suppkey", "zone_name")


@query("f5_min_support", with_sql("om", "SELECT zone, CAST(sum(y) AS BIGINT) AS total, count(*) AS months FROM om GROUP BY zone HAVING sum(y) >= 10 AND count(*) >= 6"))
def _(v):
    g = v.outcome_m().groupBy("zone").agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("months"))
    return g.filter((F.col("total") >= 10) & (F.col("months") >= 6))


@query("f6_with_without_subset", with_sql("ev", "SELECT zone, count(*) AS n, count(*) FILTER (kind <> 'error') AS without, count(*) FILTER (kind = 'error') AS removed FROM ev GROUP BY zone"))
def _(v):
    flag = text.any_column_has(["kind"], ["err"])
    return v.event().groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.count_if(~flag).alias("without"), F.count_if(flag).alias("removed"))


@query("f7_year_split", "SELECT CASE WHEN year(o_orderdate) <= 1999 THEN 'train' ELSE 'validation' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(v):
    part = F.when(F.year("o_orderdate") <= 1999, "train").otherwise("validation")
    return v.table("orders").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
