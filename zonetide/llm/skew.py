"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000  # a key with more than one row in so many is hot, so fewer than SHARE keys are
SPREAD = 64  # a hot key is dealt to so many places


def spread_over(rows: DataFrame, key: str, counts: DataFrame, count: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``counts`` with a column ``_salt`` to join on beside ``key``.

    ``counts`` has one row per key and the number of its rows.  Rows of a hot key are
    dealt by a hash of ``by``, and the row of that key in ``counts`` is given once for
    each deal.  The hot keys are fewer than ``SHARE`` by definition, whatever the input,
    and only they are broadcast.  Null keys get no salt, so they join with nothing.
    """
    total = counts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    is_hot = F.col(count) * SHARE > F.lit(total)
    hot = counts.filter(is_hot).select(F.col(key).alias("_hot"))
    dealt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*by), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int")
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", dealt).drop("_hot")
    places = F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    return left, counts.withColumn("_salt", F.explode(places))
