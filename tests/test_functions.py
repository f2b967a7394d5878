"""Column functions on hand values."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonetide.functions import dates, geo, ladders, numbers, stats, text


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_parse_number(spark):
    row = one(spark, *[numbers.parse_number(F.lit(v)) for v in ("1,5", " 2.25 ", "x", "", "NaN")], numbers.parse_number(F.lit(None).cast("string")))
    assert list(row) == [1.5, 2.25, 0.0, 0.0, 0.0, 0.0]


def test_percent_change_modes(spark):
    pc = lambda a, b, m: numbers.percent_change(F.lit(a), F.lit(b), m)
    assert list(one(spark, pc(3, 2, "null"), pc(3, 0, "null"), pc(3, 0, "hundred"), pc(0, 0, "hundred"), pc(3, 0, "unit"))) == [50.0, None, 100.0, 0.0, 300.0]


def test_ladders(spark):
    steps = [(0.8, "a"), (0.5, "b")]
    row = one(spark, ladders.ladder(F.lit(0.8), steps, "c"), ladders.ladder(F.lit(0.8), steps, "c", inclusive=True), ladders.ladder(F.lit(0.1), steps, "c"))
    assert list(row) == ["b", "a", "c"]
    bins = [ladders.cut(F.lit(v), [0, 10, 25], ["x", "y"]) for v in (0, 10, 10.5, 26)]
    assert list(one(spark, *bins)) == [None, "x", "y", None]
    alerts = [ladders.regional_alert(F.lit(0.1), F.lit(r)) for r in ("INTERIOR", "RMF", "CAPITAL")]
    assert list(one(spark, *alerts)) == ["CRITICO", "ALTO", "MEDIO"]
    assert one(spark, ladders.two_column_ladder(F.lit(0.05), F.lit(0.5)))[0] == "ALTO"


def test_text(spark):
    row = one(spark, text.normal_key(F.lit("  são   joão ")), text.plain_latin(F.lit("AÇÃO é Ñandú")), text.strip_marks(F.lit("Việt É")))
    assert list(row) == ["SÃO JOÃO", "ACAO e Nandu", "Viet E"]
    row = one(spark, text.any_word(F.lit("a.b"), ["."]), text.any_word(F.lit("ab"), ["."]), text.any_word(F.lit(None).cast("string"), ["x"]))
    assert list(row) == [True, False, False]
    assert text.description_columns(["id", "descricao_longa"]) == ["descricao_longa"]
    assert text.description_columns(["id", "x"]) == ["id", "x"]


def test_dates(spark):
    d = F.lit("2024-01-01").cast("date")
    row = one(spark, dates.weekday_name(d), dates.month_name(d), dates.is_fixed_holiday(d), dates.iso_year_week(F.lit("2021-01-03").cast("date")), dates.parse_moment(F.lit("2024-13-01"), F.lit("x")))
    assert list(row) == ["Segunda", "Janeiro", 1, "2020-W53", None]


def test_coordinates(spark):
    cases = {
        "-3.7668038,-38.584197": (-3.7668038, -38.584197),
        "[-3.5, -38.5]": (-3.5, -38.5),
        "5°15'53.4\"S,37°56'37.8\"W": (-(5 + 15 / 60 + 53.4 / 3600), -(37 + 56 / 60 + 37.8 / 3600)),
        "95.0,10.0": (None, None),
        "junk": (None, None),
    }
    for raw, want in cases.items():
        la, lo = geo.parse_coordinates(F.lit(raw))
        assert tuple(one(spark, la, lo)) == pytest.approx(want) if want[0] is not None else tuple(one(spark, la, lo)) == want


def test_haversine(spark):
    km = one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))[0]
    assert km == pytest.approx(math.pi * 6371 / 180)


def test_centroid_and_area(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    cx, cy = geo.centroid(ring)
    assert tuple(one(spark, cx, cy, geo.signed_area(ring))) == (2.0, 1.0, 8.0)


# Two-sided 5 % points of Student's t.
T_TABLE = [(1, 12.7062047), (2, 4.3026527), (3, 3.1824463), (4, 2.7764451), (5, 2.5705818), (9, 2.2621572), (10, 2.2281389), (30, 2.0422725), (61, 1.9996236), (100, 1.9839715)]


def test_student_p_table(spark):
    rows = spark.createDataFrame(T_TABLE, "df int, t double").select("df", stats.student_p(F.col("t"), F.col("df")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(0.05, abs=1e-7), r
    assert one(spark, stats.student_p(F.lit(0.0), F.lit(7)))[0] == pytest.approx(1.0)


def _t_tail(t, df, steps=20000):
    """Two-sided tail by Simpson's rule on the angle."""
    top = math.atan(t / math.sqrt(df))
    at = [math.cos(top * k / steps) ** (df - 1) * (1 if k in (0, steps) else 4 if k % 2 else 2) for k in range(steps + 1)]
    return 1 - 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * math.fsum(at) * top / steps / 3


def test_student_p_of_any_degrees(spark):
    rows = spark.createDataFrame([(d, t) for d in (1, 2, 3, 50, 1999, 2001, 40000) for t in (0.05, 0.7, 2.0, 4.0)], "df int, t double")
    for r in rows.select("df", "t", stats.student_p(F.col("t"), F.col("df")).alias("p")).collect():
        assert r.p == pytest.approx(_t_tail(r.t, r.df), abs=2e-10), r
    for z, p in ((2.0, 0.0455002639), (6.5, 8.032e-11), (1.959963984540054, 0.05)):
        assert one(spark, stats.student_p(F.lit(z), F.lit(10**9)))[0] == pytest.approx(p, rel=1e-3, abs=1e-12)
    assert one(spark, stats.student_p(F.lit(None).cast("double"), F.lit(5)))[0] is None


def test_nulls_stay_null(spark):
    none = F.lit(None).cast("double")
    assert one(spark, geo.haversine_km(none, F.lit(1.0), F.lit(2.0), F.lit(3.0)))[0] is None
    assert one(spark, numbers.clip(none, 0.0, 1.0))[0] is None
    assert one(spark, numbers.destandardise(none, F.lit(1.0), F.lit(2.0)))[0] is None


def test_safe_corr_of_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(stats.safe_corr("x", "y").alias("r")).first()[0] is None


def brute_inside(ring, x, y):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=3, max_size=7, unique=True))
def test_ray_cast_matches_brute_force(spark, ring):
    points = [(i + 0.37, j + 0.41) for i in range(-50, 50, 9) for j in range(-50, 50, 9)]
    arr = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
    df = spark.createDataFrame(points, "x double, y double").withColumn("e", geo.edges(arr))
    got = [r.i for r in df.select(geo.within(F.col("e"), F.col("x"), F.col("y")).alias("i")).collect()]
    assert got == [brute_inside(ring, x, y) for x, y in points]


def test_border_points_are_outside(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    tests = [geo.within(geo.edges(ring), F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 0), (2, 1), (1, 1))]
    assert list(one(spark, *tests)) == [False, False, False, True]
