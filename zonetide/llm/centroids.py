"""Centroid clustering with norm-of-sum bounds.

Every vector keeps an upper bound of the distance to its own centroid and one lower
bound to each other centroid, and beside each bound the round that measured it.  The
history of centroids is kept, so a bound is loosened by the norm of its centroid's
whole displacement since that round, which is never more than the sum of the drifts
of the single rounds.  A vector whose bounds stay apart is not measured; the others
are measured exactly, in integers, against the centroids whose bounds fail.

A round is one pass over the written state and one grouped sum, folded in tasks
first; the driver holds nothing but the centroids of all rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.session import cut_lineage

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
MOST = 1 << 26  # integers are held to this, so that a squared distance fits 64 bits
MOST_SUM = (1 << 63) - 1  # and sums to this
SLACK = 1e-6  # above the rounding of a square root of an integer below 2**60
_STATE = "cluster int, upper double, measured int, lower array<float>, since array<byte>, distance long"


def finite(vector: str) -> F.Column:
    """True where no component is null or not finite; false for a null vector."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def floored(vector: str, scale: int) -> F.Column:
    """floor(scale * x) of each component, x as double."""
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def exact(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to one centroid."""
    gap = x - centroid
    return (gap * gap).sum(axis=1)


def first_bounds(x: np.ndarray, centroids: np.ndarray) -> dict[str, np.ndarray]:
    """State after measuring everything against the first centroids."""
    square = np.stack([exact(x, c) for c in centroids], axis=1)
    cluster = square.argmin(axis=1)  # the first of equal ones
    distance = square[np.arange(len(x)), cluster]
    return {
        "cluster": cluster, "distance": distance, "upper": np.sqrt(distance), "measured": np.zeros(len(x), np.int64),
        "lower": np.sqrt(square), "since": np.zeros(square.shape, np.int64),
    }


def next_bounds(x: np.ndarray, state: dict[str, np.ndarray], history: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
    """State for the last centroids of ``history`` (rounds x clusters x dimensions), and how many distances were measured."""
    now, last = history[-1], len(history) - 1
    moved = np.sqrt(((now[None] - history) ** 2).sum(axis=2))
    cluster, upper, measured, lower, since = (state[k].copy() for k in ("cluster", "upper", "measured", "lower", "since"))
    bound = lower - moved[since, np.arange(len(now))[None, :]] - SLACK
    bound[np.arange(len(x)), cluster] = np.inf
    apart = upper + moved[measured, cluster] + SLACK < bound.min(axis=1, initial=np.inf)
    square = np.full(len(x), -1, np.int64)
    work = 0
    for k in range(len(now)):  # the upper bounds that fail
        rows = np.flatnonzero(~apart & (cluster == k))
        square[rows] = exact(x[rows], now[k])
        work += len(rows)
    rest = np.flatnonzero(~apart)
    upper[rest], measured[rest] = np.sqrt(square[rest]), last
    own, best, least = cluster.copy(), cluster.copy(), square.copy()
    for k in range(len(now)):  # the lower bounds that fail, smaller numbers first
        rows = rest[bound[rest, k] <= upper[rest] + SLACK]
        found = exact(x[rows], now[k])
        work += len(rows)
        lower[rows, k], since[rows, k] = np.sqrt(found), last
        better = (found < least[rows]) | ((found == least[rows]) & (k < best[rows]))
        best[rows[better]], least[rows[better]] = k, found[better]
    lost = np.flatnonzero(best != own)
    lower[lost, own[lost]], since[lost, own[lost]] = np.sqrt(square[lost]), last
    cluster = best
    upper[lost], measured[lost] = np.sqrt(least[lost]), last
    return {"cluster": cluster, "distance": least, "upper": upper, "measured": measured, "lower": lower, "since": since}, work


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def _assigned(rows: DataFrame, history: np.ndarray, final: bool) -> DataFrame:
    """``rows`` (vec_id, v and the state of the round before, if any) with the state for the last centroids."""
    first, clusters = len(history) == 1, history.shape[1]

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["v"], history.shape[2], np.int64)
            if first:
                state = first_bounds(x, history[0])
            else:
                state = {k: batch[k].to_numpy() for k in ("cluster", "upper", "measured")}
                state |= {"lower": _matrix(batch["lower"], clusters, np.float64), "since": _matrix(batch["since"], clusters, np.int64)}
                state, _ = next_bounds(x, state, history)
            if final:
                for k in range(clusters):
                    own = np.flatnonzero(state["cluster"] == k)
                    state["distance"][own] = exact(x[own], history[-1][k])
            low = state["lower"].astype(np.float32)
            low = np.maximum(np.nextafter(low, np.float32(-np.inf)), 0)  # never above the measured distance
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["v"], pa.array(state["cluster"], pa.int32()), pa.array(state["upper"], pa.float64()), pa.array(state["measured"], pa.int32()),
                 _lists(low, pa.float32()), _lists(state["since"], pa.int8()), pa.array(state["distance"], pa.int64())],
                ["vec_id", "v", "cluster", "upper", "measured", "lower", "since", "distance"],
            )

    return rows.mapInArrow(advance, f"vec_id {dict(rows.dtypes)['vec_id']}, v array<int>, {_STATE}")


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; an empty one stays where it was."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(before.shape[1])]
    after = before.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # one row per cluster
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(before.shape[1])]
    return after


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors kept.

    ``vectors`` holds (vec_id, embedding, ...); vectors with exactly ``dimensions``
    components, none null or non-finite, are kept and become integers floor(64 * x), held
    to +-2**26; sums beyond 64 bits are held to the greatest.  The first centroids are the vectors with the smallest sha256 of
    ``1:<vec_id>``; of rows that share a vec_id the smaller vector comes first, null ids
    come last.  Each round assigns every vector to the nearest centroid, ties to the
    smaller number, and replaces every centroid that has vectors by the floor of their
    mean; then vectors are assigned once more.  Repeated rows are separate rows.  With
    fewer vectors than clusters there are as many clusters as vectors; without vectors
    there are no rows.  Other columns are ignored.  ``rounds`` is below 128.
    """
    chosen = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("_v"))
    kept = chosen.filter(finite("_v") & (F.size("_v") == dimensions)).select("vec_id", floored("_v", SCALE).alias("v"))
    rows = cut_lineage(kept, "points")
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    seeds = rows.orderBy(order.asc_nulls_last(), "v").limit(clusters).collect()
    history = np.array([r["v"] for r in seeds], np.int64).reshape(1, len(seeds), dimensions)
    for t in range(rounds + 1):
        rows = cut_lineage(_assigned(rows, history, t == rounds), f"round{t}")
        if t < rounds and len(seeds):
            history = np.concatenate([history, _means(rows, history[-1])[None]])
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i")).collect()
    per = {r["cluster"]: min(int(r["i"]), MOST_SUM) for r in sums}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    pick = lambda values, kind: F.array(*(F.lit(x) for x in values)).cast(f"array<{kind}>")[F.col("cluster")]
    return rows.select(
        "vec_id", "cluster", "distance", pick([per.get(k, 0) for k in range(len(names))], "long").alias("cluster_inertia"),
        F.lit(min(sum(per.values()), MOST_SUM)).cast("long").alias("inertia"), pick(names, "string").alias("centroid_sha256"),
    )
