"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonetide.plans.views import Views

REGISTRY: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so the order of a sum does not show."""
    cols = [
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register a query; doubles of its result are rounded."""

    def add(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def run(name: str, spark, sf_dir: str) -> DataFrame:
    # the tables carry times without zone; days must not depend on the machine
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return rounded(REGISTRY[name][0](Views(spark, sf_dir)))
