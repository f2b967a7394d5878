"""Embedding near-dedup by tiles of vectors that lie near one another.

Vectors are rotated and ordered by the cells of the first coordinates of their blocks,
and cut into tiles that are written once, each a row with the box around its vectors.
Tiles meet in a non-equi join on the distance of their boxes, which Spark runs as a
product of partitions, so no vector is shuffled once per other tile.  Inside a task the
same holds for the steps of a tile: what boxes leave open is multiplied in single
precision, and what that leaves open in double precision.  Tasks return the number of
links of each vector and a spanning forest, no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.llm.components import components, grow_forest
from zonetide.llm.textscan import signed
from zonetide.session import cut_lineage

LEAST = 0.95
BLOCK = 8
CELLS = 8  # blocks whose cells order the vectors
TILE = 8192  # vectors of a tile; fewer if they are longer than USUAL
USUAL = 64
SPARE = 32  # a small table has about so many tiles
LEAST_TILE = 256
SIDES = 12  # partitions of tiles on one side of the product, of TOGETHER tiles in a large table
TOGETHER = 8
STEP = 1024  # vectors on one side of a product inside a task
PAIRS = 1 << 15  # pairs multiplied in double precision at a time
SLACK = 1 + 1e-9


def rotation(size: int) -> np.ndarray:
    """A fixed random rotation, so that no block depends on the order of the dimensions."""
    return np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]


def blocks_of(size: int) -> list[np.ndarray]:
    return np.array_split(np.arange(size), max(1, size // BLOCK))


def _turned(raw: np.ndarray) -> np.ndarray:
    """Rotated unit vectors; a length that is no number of its own gives no unit and no link."""
    with np.errstate(all="ignore"):
        return (raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))) @ rotation(raw.shape[1])


def valid(vector: str) -> F.Column:
    """Rows with numbers in every component and a length above zero."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _singles(raw: np.ndarray) -> np.ndarray:
    """Which rows are the same in single precision."""
    with np.errstate(all="ignore"):
        return (raw.astype("<f4").astype("<f8") == raw).all(axis=1)


def _raw(data: pa.Array, size: int) -> np.ndarray:
    """Vectors of one size from their bytes, in single or double precision."""
    width = pc.binary_length(data).to_numpy(zero_copy_only=False) // size
    out = np.empty((len(data), size))
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(data.take(pa.array(at)).to_pylist()), f"<f{w}").reshape(-1, size)
    return out


def _boxes(x: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of every ``step`` vectors."""
    x = np.nan_to_num(x, nan=0.0, posinf=1.0, neginf=-1.0)
    at = np.arange(0, len(x), step)
    return np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)


def _near(x: np.ndarray, y: np.ndarray, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of linked pairs of x and y (rotated units)."""
    reach = (2 - 2 * least) * SLACK + 1e-9
    slack = (x.shape[1] + 4) * 2.0**-23  # what single precision adds or takes
    (xl, xh), (yl, yh) = _boxes(x, STEP), _boxes(y, STEP)
    with np.errstate(all="ignore"):
        xs, ys = x.astype(np.float32), y.astype(np.float32)
        for k, i in enumerate(range(0, len(x), STEP)):
            gap = np.maximum(np.maximum(yl - xh[k], xl[k] - yh), 0.0)
            for j in (np.flatnonzero((gap * gap).sum(axis=1) <= reach) * STEP).tolist():
                if same and j < i:
                    continue
                product = xs[i : i + STEP] @ ys[j : j + STEP].T
                a, b = np.nonzero(product >= least - slack)
                if same and i == j:
                    a, b = a[b > a], b[b > a]
                linked = product[a, b] >= least + slack
                unsure = np.flatnonzero(~linked)
                for at in range(0, len(unsure), PAIRS):
                    u = unsure[at : at + PAIRS]
                    linked[u] = (x[i + a[u]] * y[j + b[u]]).sum(axis=1) >= least
                if linked.any():
                    yield i + a[linked], j + b[linked]


class _Links:
    """Links counted and trees grown over the vectors of the tiles that a task has met."""

    def __init__(self):
        self.begins: dict[int, int] = {}
        self.ids, self.links, self.parent = (np.zeros(0, np.int64) for _ in range(3))

    def place(self, tile: int, ids: np.ndarray) -> int:
        if tile not in self.begins:
            self.begins[tile] = begin = len(self.ids)
            self.ids = np.append(self.ids, ids)
            self.links = np.append(self.links, np.zeros(len(ids), np.int64))
            self.parent = np.append(self.parent, np.arange(begin, begin + len(ids)))
        return self.begins[tile]

    def add(self, a: np.ndarray, b: np.ndarray, more: np.ndarray, other: np.ndarray) -> None:
        np.add.at(self.links, a, more)
        np.add.at(self.links, b, other)
        grow_forest(self.parent, a, b)

    def found(self) -> pa.RecordBatch:
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        least = self.ids.copy()
        np.minimum.at(least, self.parent, self.ids)
        hit = self.links > 0
        return pa.RecordBatch.from_arrays([signed(self.ids[hit]), signed(self.links[hit]), signed(least[self.parent[hit]])], ["rep", "n", "root"])


def _packed(least: float):
    """Task that gives each vector as bytes, and a code of the cells of its blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch["_v"]), 0).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                if not size:
                    none = pa.nulls(len(part), pa.binary())
                    yield pa.RecordBatch.from_arrays([part["vec_id"], signed(np.zeros(len(part))), none, none], ["vec_id", "size", "code", "data"])
                    continue
                raw = part["_v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype("<f8") + 0.0  # one zero
                turned = np.nan_to_num(_turned(raw), nan=0.0, posinf=1.0, neginf=-1.0)
                wide = [(p[0], math.sqrt(((2 - 2 * least) * SLACK + 1e-9) * len(p) / size)) for p in blocks_of(size)[:CELLS]]
                code = np.stack([np.clip(np.floor(turned[:, d] / w) + 128, 0, 255).astype(np.uint8) for d, w in wide], axis=1)
                data = [x.astype("<f4").tobytes() if single else x.tobytes() for x, single in zip(raw, _singles(raw).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"], signed(np.full(len(part), size)), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(data, pa.binary())],
                    ["vec_id", "size", "code", "data"],
                )

    return pack


_TILES = "size long, low array<double>, high array<double>, ids binary, times binary, width int, data binary"


def _tiled(most: int):
    """Task that puts ordered vectors together in rows of ``most``."""

    def one(size: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, times, raw = (np.concatenate(x) for x in zip(*rows))
        (low,), (high,) = _boxes(_turned(raw), len(raw))
        width = 4 if _singles(raw).all() else 8
        return pa.RecordBatch.from_pylist(
            [{"size": size, "low": low.tolist(), "high": high.tolist(), "ids": ids.tobytes(), "times": times.tobytes(), "width": width, "data": raw.astype(f"<f{width}").tobytes()}],
            pa.schema([("size", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("times", pa.binary()), ("width", pa.int32()), ("data", pa.binary())]),
        )

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, count = 0, [], 0
        for batch in batches:
            sizes = batch["size"].to_numpy()
            at = 0
            while at < len(sizes):
                size = int(sizes[at])
                if rows and (size != held or count >= min(most, max(1, TILE * USUAL // size))):
                    yield one(held, rows)
                    rows, count = [], 0
                held, other = size, np.flatnonzero(sizes[at:] != size)
                n = min(len(sizes) - at if not len(other) else int(other[0]), min(most, max(1, TILE * USUAL // size)) - count)
                part = batch.slice(at, n)
                rows.append((part["rep"].to_numpy().astype(np.int64), part["m"].to_numpy(), _raw(part["data"], size)))
                at, count = at + n, count + n
        if rows:
            yield one(held, rows)

    return tile


def _linked(least: float):
    """Task that finds the links of pairs of tiles."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                sides = []
                for s in "ab" if row["a_no"] != row["b_no"] else "a":
                    raw = np.frombuffer(row[f"{s}_data"], f"<f{row[f'{s}_width']}").reshape(-1, row["a_size"]).astype(np.float64)
                    begin = links.place(row[f"{s}_no"], np.frombuffer(row[f"{s}_ids"], np.int64))
                    sides.append((begin, np.frombuffer(row[f"{s}_times"], np.int64), _turned(raw)))
                (ab, am, x), (bb, bm, y) = sides[0], sides[-1]
                for a, b in _near(x, y, len(sides) == 1, least):
                    links.add(ab + a, bb + b, bm[b], am[a])
        yield links.found()

    return link


def _apart(low: str, high: str, other_low: str, other_high: str) -> Column:
    """Squared distance of two boxes."""
    over = F.zip_with(low, other_high, lambda p, q: p - q)
    under = F.zip_with(other_low, high, lambda p, q: p - q)
    gap = F.zip_with(over, under, lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def tiles_of(coded: DataFrame) -> DataFrame:
    """One row per tile of different vectors, written; ``coded`` (vec_id, size, code, data)."""
    n = coded.count()
    most = max(1, min(TILE, max(LEAST_TILE, -(-n // SPARE))))
    parts = max(1, -(-n // most))
    classes = coded.groupBy("size", "code", "data").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"))
    ordered = classes.repartitionByRange(parts, "size", "code", "rep").sortWithinPartitions("size", "code", "rep").coalesce(parts)
    tiles = ordered.select("size", "rep", "m", "data").mapInArrow(_tiled(most), _TILES)
    return cut_lineage(tiles.withColumn("no", F.monotonically_increasing_id()), "tiles")


def met(tiles: DataFrame, least: float) -> DataFrame:
    """Pairs of tiles (a_..., b_...), a tile and itself among them, whose boxes allow a link; each pair comes once.

    The condition has no equality, as that would send all tiles of a size to one task.
    Of two tiles either may be the first, so that all partitions of a side have work.
    """
    n = tiles.count()
    side = tiles.withColumn("turn", F.pmod(F.xxhash64("no"), F.lit(2))).coalesce(max(1, min(n, max(SIDES, -(-n // TOGETHER)))))
    a, b = (side.select(*(F.col(c).alias(f"{s}_{c}") for c in side.columns)) for s in "ab")
    one_size = (F.col("a_size") <= F.col("b_size")) & (F.col("a_size") >= F.col("b_size"))
    once = (F.col("a_no") == F.col("b_no")) | ((F.col("a_no") < F.col("b_no")) == (F.col("a_turn") == F.col("b_turn")))
    near = _apart("a_low", "a_high", "b_low", "b_high") <= (2 - 2 * least) * SLACK + 1e-9
    return a.join(b, one_size & once & near).select("a_size", *(f"{s}_{c}" for s in "ab" for c in ("no", "ids", "times", "width", "data")))


def linked_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, ...).

    Two vectors link if their cosine, in double precision, is ``least`` or more.
    ``n_links`` counts the other vectors linked directly, ``component_id`` is the
    least vec_id reached, ``kept`` marks vectors that are their own component.
    Null or zero vectors and those with null or non-finite components link with
    nothing, and so do vectors of different length; a null vec_id links with
    nothing; rows of equal vectors are one class and link with one another, also
    under one vec_id; different vectors of one vec_id are one node; an empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("_v"))
    usable = F.when(valid("_v") & F.col("vec_id").isNotNull(), F.col("_v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    coded = rows.select("vec_id", usable.alias("_v")).mapInArrow(_packed(least), f"vec_id {kind}, size long, code binary, data binary")
    good = coded.filter("data is not null")
    found = cut_lineage(met(tiles_of(good), least).mapInArrow(_linked(least), "rep long, n long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("_n"))
    label = components(found, "rep", "root").select(F.col("node").alias("rep"), F.col("component").alias("_c"))
    # a class is known by a digest from here on, vectors themselves travel no more
    digest = F.unhex(F.md5(F.concat(F.concat_ws("", F.col("size").cast("string"), F.lit(":")).cast("binary"), F.col("data"))))
    named = coded.select("vec_id", F.when(F.col("data").isNotNull(), digest).alias("_h"))
    classes = named.filter("_h is not null").groupBy("_h").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"))
    per_class = classes.join(counts, "rep", "left").join(label, "rep", "left").select(
        F.col("_h").alias("_w"), (F.coalesce("_n", F.lit(0)) + F.col("m") - 1).alias("_links"), F.coalesce("_c", "rep").alias("_comp"))
    joined = named.join(per_class, F.col("_h") == F.col("_w"), "left")
    comp = F.coalesce("_comp", "vec_id")
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"))
