"""Connected components of links by alternating star joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.session import cut_lineage


def grow_forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i] in place, inside one task; a root is the least of its tree."""
    while len(a):
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``links``; component is the least node reached.

    Each round hangs every neighbour of a node below the least one it knows, first
    over all neighbours, then over the smaller ones; rounds grow with the logarithm
    of the longest path.  Every step is a grouped minimum and an equi-join, and
    each round is written to the shared folder.  Null ends and loops are ignored;
    no links give no rows.
    """
    edges = (
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .filter("a is not null and b is not null and a <> b").distinct()
    )
    edges = cut_lineage(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        stars = edges.join(least, "a").select("a", "b", "m")
        edges = (
            stars.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        edges = cut_lineage(edges, "stars")
        state, last = _state(edges), state
        if state == last:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
