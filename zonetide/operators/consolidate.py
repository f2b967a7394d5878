"""From raw events to the consolidated fact, and from there to the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.functions.dates import is_fixed_holiday
from zonetide.functions.numbers import cap_scale, parse_number
from zonetide.functions.text import OUTCOME_WORDS_UPPER, any_word, plain_latin
from zonetide.operators import spatial, windows
from zonetide.operators.joins import cascade, lookup
from zonetide.operators.panel import densify
from zonetide.operators.ranking import column_quantiles
from zonetide.sources.files import rename_aliases

# The study area as south, north, west, east, and the layers of
# the zones in order of priority.
STUDY_BOX = (-8.0, -2.0, -42.0, -37.0)
LAYERS = ["CAPITAL", "RMF", "INTERIOR"]


def consolidated_events(
    raw: DataFrame, key: str, polygons: DataFrame, zones: DataFrame, labels: DataFrame,
    box: Sequence[float] = STUDY_BOX, layers: Sequence[str] = LAYERS, words: Sequence[str] = OUTCOME_WORDS_UPPER, neutral: str = "NEUTRO",
) -> DataFrame:
    """Clean, place, classify and label raw events.

    ``polygons`` (poly, ring), ``zones`` (poly, zone, layer) and ``labels``
    (zone, label) are dimensions.  An event inside several zones keeps the one
    of the first layer.
    """
    named = rename_aliases(raw).withColumns({c: parse_number(c, None) for c in ("lat", "long")})
    placed = spatial.points_in_polygons(spatial.in_box(named, "lat", "long", box), polygons, "poly", "ring", "long", "lat")
    one = cascade(placed.join(zones, "poly"), key, "layer", layers, F.col("zone"), F.col("poly"))
    kind = F.when(any_word(F.upper(plain_latin("natureza")), words), "CVLI").otherwise("CVP")
    return lookup(one.withColumn("kind", kind), labels, "zone", "label", neutral)


def feature_panel(events: DataFrame, zone: str, date: str, amounts: Sequence[str]) -> DataFrame:
    """Daily sums scaled by the events' 99th percentile, zero-filled, with lags,
    trailing means, volatility, intensity and cycles of the scaled columns."""
    caps = column_quantiles(events, {a: (a, 0.99) for a in amounts})
    daily = events.groupBy(zone, date).agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(a) for a in amounts])
    scaled = daily.withColumns({f"{a}_norm": cap_scale(F.col(a), caps[a]) for a in amounts})
    norms = [f"{a}_norm" for a in amounts]
    grid = densify(scaled, zone, date, ["n", *amounts, *norms])
    return windows.all_features(grid, zone, date, norms)


def station_planes(grid: DataFrame, readings: DataFrame, stations: DataFrame, polygons: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Mean station readings per (zone, date) of a grid, 0 where there are none,
    with the holiday flag.

    ``readings`` (id, date, measures), ``stations`` (id, lon, lat) and
    ``polygons`` (poly, ring); stations outside every polygon go to the nearest.
    """
    seats = spatial.assign_zones(stations, polygons, "id", "poly", "ring", "lon", "lat").select("id", F.col("poly").alias("zone"))
    # sums per station and date first, so the join moves one row for each
    sums = readings.groupBy("id", "date").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures], *[F.count(m).alias(f"_n_{m}") for m in measures])
    means = sums.join(seats, "id").groupBy("zone", "date").agg(
        *[F.try_divide(F.sum(f"_s_{m}").cast("double"), F.sum(f"_n_{m}")).alias(m) for m in measures]
    )
    return grid.join(means, ["zone", "date"], "left").na.fill(0.0, subset=list(measures)).withColumn("holiday", is_fixed_holiday("date"))
