"""Hot groups, plans and the shared folder."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonetide.operators import panel, ranking, spatial, windows
from zonetide.plans.audit import audit, plan_text
from zonetide.plans.views import Views
from zonetide.session import cut_lineage, scratch_path, shared_folder


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all events in one zone, on one day, with one value."""
    third = F.col("id") % 3 == 0
    return spark.range(60_000).select(
        F.when(third, 0).otherwise(F.col("id") % 97).cast("int").alias("zone"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.when(third, 3).otherwise(F.col("id") % 31).cast("int")).alias("date"),
        F.when(third, 1.5).otherwise(F.col("id") * 0.001).alias("value"),
    )


def test_hot_zone_panel(hot):
    daily = panel.keyed_counts(hot, ["zone", "date"], "n")
    p = panel.densify(daily, "zone", "date", ["n"])
    got = windows.trailing_means(p, "zone", "date", ["n"], (7,)).toPandas().sort_values(["zone", "date"])
    assert len(got) == 97 * 31 and got.n.sum() == 60_000
    want = got.groupby("zone").n.rolling(7, min_periods=1).mean().to_numpy()
    assert np.allclose(got.n_ma7, want)


def test_hot_value_ranks_and_quantiles(hot):
    pdf = hot.toPandas()
    got = ranking.quantiles(hot, "value", {"a": 0.2, "b": 0.5, "c": 0.999}, ["date"]).toPandas().set_index("date").sort_index()
    want = pdf.groupby("date").value.quantile([0.2, 0.5, 0.999]).unstack()
    assert np.allclose(got[["a", "b", "c"]], want)
    ranked = ranking.average_rank(hot, "value", ["zone"], percent=True).toPandas()
    assert np.allclose(ranked["rank"], ranked.groupby("zone").value.rank(pct=True))


def test_hot_cell_join(spark):
    """A third of the points on one spot, many in one cell, and a border of many
    short edges."""
    t = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    star = [(float(x), float(y)) for x, y in zip((3 + np.sin(9 * t)) * np.cos(t), (3 + np.sin(9 * t)) * np.sin(t), strict=True)]
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in star])
    polys = spark.range(1).select(F.col("id").alias("poly"), ring.alias("ring"))
    rng = np.random.default_rng(8)
    pts = pd.DataFrame({"x": rng.uniform(-5, 5, 3000), "y": rng.uniform(-5, 5, 3000)})
    pts.loc[pts.index % 3 == 0, ["x", "y"]] = (0.11, 0.13)
    pts["id"] = range(3000)
    x1, y1 = np.array(star).T
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    px, py = pts.x.to_numpy()[:, None], pts.y.to_numpy()[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        hits = ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    want = set(pts.id[hits.sum(1) % 2 == 1])
    for size in (None, 0.3, 7.0):
        got = spatial.points_in_polygons(spark.createDataFrame(pts), polys, "poly", "ring", "x", "y", size)
        assert {r.id for r in got.collect()} == want


def test_feature_plan_has_two_exchanges(spark, sf_dir):
    f = windows.all_features(Views(spark, sf_dir).panel(), "zone", "date", ["n", "click", "view"])
    counts = audit(f)
    # one to (zone, date), one to zone; the bounds are scalar subqueries
    assert counts["exchanges"] == 2 and counts["smj"] == counts["bhj"] == counts["python"] == 0


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    text = plan_text(Views(spark, sf_dir).outcome_m())
    assert "EqualTo(o_orderpriority,1-URGENT)" in text and "o_totalprice" not in text


class FakeSession:
    """Just what the folder lookup reads."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = SimpleNamespace(master=master)


def test_folder_comes_from_the_session():
    assert shared_folder(FakeSession("hdfs:///shared/", "yarn")) == "hdfs:///shared"
    assert scratch_path(FakeSession("hdfs:///shared", "yarn"), "x").startswith("hdfs:///shared/zonetide-x-")
    local = shared_folder(FakeSession(None, "local[8]"))
    assert local == shared_folder(FakeSession(None, "local[2]"))
    with pytest.raises(ValueError):
        shared_folder(FakeSession(None, "spark://host:7077"))


def test_cut_lineage_reads_a_written_table(spark):
    df = cut_lineage(spark.range(5).filter("id > 1"), "five")
    assert df.count() == 3 and "Range" not in plan_text(df) and "parquet" in plan_text(df)
