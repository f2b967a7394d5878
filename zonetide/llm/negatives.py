"""Hard-negative mining over tiles of points, each searched through a packed R-tree.

Points are cut into tiles by two range partitions (slabs of one dimension, then tiles
of the next), as the trees are inside a tile.  The box of each label of a tile gives
an interval of the inner product, so a query visits its best tile first and then only
tiles whose interval meets a window and does not lie strictly below the k-th score
already found.  Tiles and queries meet in groups of bounded size; what they return is
merged by a grouped first k.  Equal queries are one query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonetide.llm.rtree import FAR, Tree, intervals, kind_of
from zonetide.llm.skew import spread_over
from zonetide.session import cut_lineage

TILE = 4096  # points of a tile, about
BLOCK = 512  # queries that visit a tile together, about
BOXES = 2048  # boxes that a block of queries is held against at once, about


def _rows(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size).astype(np.int64)


def tiles_of(points: DataFrame) -> DataFrame:
    """``points`` (vec_id, label, v) with ``size`` and ``tile``: sort-tile-recursive over two dimensions.

    The dimensions are those that spread most among all points of the commonest length.
    """
    sized = points.withColumn("size", F.size("v"))
    n = sized.groupBy("size").count().collect()  # one row per length of vectors
    total = sum(r["count"] for r in n)
    size = max(n, key=lambda r: (r["count"], r["size"]))["size"] if n else 0
    parts = -(-total // TILE) or 1
    spread = sized.filter(F.col("size") == size).agg(*(F.var_pop(F.col("v")[i]).alias(f"s{i}") for i in range(size))).first() if size > 0 else []
    first, second, *_ = [*sorted(range(max(size, 0)), key=lambda i: (-(spread[i] or 0), i)), 0, 0]
    slabs = sized.repartitionByRange(math.ceil(math.sqrt(parts)), "size", F.get("v", F.lit(first)), "v", "label", "vec_id")
    slabs = cut_lineage(slabs.withColumn("slab", F.spark_partition_id()), "slabs")
    tiles = slabs.repartitionByRange(parts, "size", "slab", F.get("v", F.lit(second)), "v", "label", "vec_id")
    return cut_lineage(tiles.withColumn("tile", F.spark_partition_id().cast("long")).drop("slab"), "tiles")


def boxes_of(tiles: DataFrame) -> DataFrame:
    """(tile, size, label, lo, hi) of the points of a label in a tile; a tile may have several boxes of a label."""

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for size in pc.unique(table["size"]).to_pylist():
                part = table.filter(pc.equal(table["size"], size)).sort_by([("tile", "ascending"), ("label", "ascending")])
                x = _rows(part["v"], size)
                tile, label = part["tile"].to_numpy(), part["label"].to_numpy()
                begin = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (label[1:] != label[:-1])])
                lo, hi = np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile[begin], pa.int64()), pa.array(np.full(len(begin), size), pa.int32()), pa.array(label[begin], pa.int64()),
                     pa.array(lo.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(hi.astype(np.int32).tolist(), pa.list_(pa.int32()))],
                    ["tile", "size", "label", "lo", "hi"],
                )

    return cut_lineage(tiles.mapInArrow(boxes, "tile long, size int, label long, lo array<int>, hi array<int>"), "boxes")


def _visits(queries: DataFrame, boxes: DataFrame, blocks: int, panes: int, same: bool) -> DataFrame:
    """(q, size, tile, bottom, top): the tiles whose interval meets a window of the query."""

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        names = {"q": pa.int64(), "size": pa.int32(), "tile": pa.int64(), "bottom": pa.int64(), "top": pa.int64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        size = left["size"][0].as_py()
        right = right.sort_by("tile")
        a, lo, hi = _rows(left["a"], size), _rows(right["lo"], size), _rows(right["hi"], size)
        kind = kind_of(a, np.concatenate([lo, hi]))
        bottom, top = intervals(a.astype(kind), lo.astype(kind), hi.astype(kind))
        fits = (left["label"].to_numpy()[:, None] == right["label"].to_numpy()[None, :]) == same
        meets = np.zeros_like(fits)
        for i, (low, high) in enumerate(zip(left["low"].to_pylist(), left["high"].to_pylist())):
            for x, y in zip(low, high):
                meets[i] |= (top[i] >= x) & (bottom[i] <= y)
        meets &= fits
        tile = right["tile"].to_numpy()
        begin = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        top = np.maximum.reduceat(np.where(meets, top, -FAR), begin, axis=1).astype(np.int64)
        bottom = np.minimum.reduceat(np.where(meets, bottom, FAR), begin, axis=1).astype(np.int64)
        i, j = np.nonzero(np.logical_or.reduceat(meets, begin, axis=1))
        cols = [left["q"].to_numpy()[i], np.full(len(i), size), tile[begin][j], bottom[i, j], top[i, j]]
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(names.items(), cols)})

    pane = F.pmod(F.xxhash64("tile"), F.lit(panes)).cast("int")
    left = queries.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("pane", F.explode(F.sequence(F.lit(0), F.lit(panes - 1))))
    right = boxes.withColumn("pane", pane).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["size", "block", "pane"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(route, "q long, size int, tile long, bottom long, top long")
    return cut_lineage(met, "visits")


def _searched(queries: DataFrame, visits: DataFrame, tiles: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """(q, w, score, id): the first k of each window and query in each tile visited."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            size = left["size"][0].as_py()
            a, x = _rows(left["a"], size), _rows(right["v"], size)
            kind = kind_of(a, x)
            tree = Tree.of(x.astype(kind), right["vec_id"].to_numpy(), right["label"].to_numpy())
            every = {label: [n for other, nodes in tree.roots.items() if (other == label) == same for n in nodes] for label in set(left["label"].to_pylist())}
            columns = (left[c].to_pylist() for c in ("q", "label", "low", "high", "floor"))
            for vector, q, label, low, high, floor in zip(a.astype(kind), *columns):
                for w, found in enumerate(tree.search(vector, every[label], low, high, floor, k)):
                    out += [(q, w, s, i) for s, i in found]
        cols = np.array(out, np.int64).reshape(-1, 4)
        return pa.table({"q": cols[:, 0], "w": cols[:, 1].astype(np.int32), "score": cols[:, 2], "id": cols[:, 3]})

    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    left = visits.select("q", "tile").join(queries, "q").withColumn("block", block)
    met = cut_lineage(left.select("size", "tile", "block").distinct(), "met")
    right = tiles.join(met, ["size", "tile"])
    keys = ["size", "tile", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "q long, w int, score long, id long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def first_in_windows(queries: DataFrame, tiles: DataFrame, boxes: DataFrame, k: int, same: bool) -> DataFrame:
    """(q, w, score, id, rank): the k points of highest inner product in each window of each query.

    ``queries`` holds (q, label, a, low, high): window w takes scores from low[w] to
    high[w].  Points are of the query's label (``same``) or of every other label, and of the
    query's length.  Ties go to the smaller id.
    """
    n, panes = queries.count(), boxes.count()
    if not n or not panes:
        return queries.sparkSession.createDataFrame([], "q long, w int, score long, id long, rank int")
    blocks, panes = -(-n // BLOCK), -(-panes // BOXES)
    queries = queries.withColumn("size", F.size("a"))
    visits = _visits(queries, boxes, blocks, panes, same)
    best = visits.groupBy("q").agg(F.max_by("tile", F.struct("top", -F.col("tile"))).alias("tile"))
    open_ = queries.withColumn("floor", F.transform("low", lambda x: F.lit(None).cast("long")))
    found = cut_lineage(_searched(open_, best, tiles, blocks, k, same), "seeds")
    # the k-th score of each window that is full by now
    full = _first(found, k).filter(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("_full"))
    floors = F.transform("low", lambda _, i: F.try_element_at("_full", i.cast("int")))
    bounded = cut_lineage(queries.join(full, "q", "left").withColumn("floor", floors).drop("_full"), "bounded")
    window = F.arrays_zip("low", "high", "floor")
    open_window = F.exists(window, lambda z: (F.col("top") >= z["low"]) & (F.col("bottom") <= z["high"]) & (z["floor"].isNull() | (F.least("top", z["high"]) >= z["floor"])))
    rest = visits.join(best, ["q", "tile"], "left_anti").join(bounded.select("q", "low", "high", "floor"), "q").filter(open_window)
    return _first(found.unionByName(_searched(bounded, rest, tiles, blocks, k, same)), k)


def hard_negatives(points: DataFrame, is_anchor: F.Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors among ``points``.

    ``points`` holds (vec_id, label, v) with integer vectors and labels, and ``is_anchor`` tells the anchors.
    An anchor's positives are its first ``positives`` other points of the same label by inner
    product, ties to the smaller id; the negatives of a positive are the first ``negatives``
    points of other labels whose score is from ``low`` to ``high`` percent of the
    positive's.  A negative positive score has an empty window.  Vectors of different
    length do not meet.  Points with a null id, label or vector, or a null component, take no
    part; rows of one id count once, with the smallest label and vector.  Equal points
    are held only by their first ids, since later ones rank below them, and equal
    anchors are searched once.  Without anchors, or partners, there are no rows; other columns are ignored.
    """
    label_type = dict(points.dtypes)["label"]
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    whole = points.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v", is_anchor.alias("anchor")).filter(fine)
    rows = cut_lineage(whole.groupBy("vec_id").agg(F.min(F.struct("label", "v", "anchor")).alias("p")).select("vec_id", "p.*"), f"rows-{label_type}")
    place = Window.partitionBy("label", "v").orderBy("vec_id")
    ranked = rows.select("vec_id", "label", "v").withColumn("_n", F.row_number().over(place))
    tiles = tiles_of(ranked.filter(F.col("_n") <= max(positives + 1, negatives)).drop("_n"))
    boxes = boxes_of(tiles)

    anchors = rows.filter("anchor").select(F.col("vec_id").alias("anchor_id"), F.struct("label", "v").alias("c"))
    groups = cut_lineage(anchors.groupBy("c").agg(F.min("anchor_id").alias("q"), F.count(F.lit(1)).alias("n")), "anchors")
    ask = groups.select("q", "c.label", F.col("c.v").alias("a"))
    all_scores = ask.withColumn("low", F.array(F.lit(-FAR))).withColumn("high", F.array(F.lit(FAR)))
    near = first_in_windows(all_scores, tiles, boxes, positives + 1, True)
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("_list"))
    left, right = spread_over(anchors, "c", groups.join(lists, "q"), "n", ["anchor_id"])
    own = F.slice(F.filter("_list", lambda z: z["positive_id"] != F.col("anchor_id")), 1, positives)
    pairs = left.join(right, ["c", "_salt"]).select("anchor_id", "q", F.explode(own).alias("z")).select("anchor_id", "z.positive_id", F.struct("q", F.col("z.positive_score").alias("p")).alias("c"))
    pairs = cut_lineage(pairs.filter("c.p >= 0"), "positives")

    windows = pairs.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    scores = windows.groupBy("c.q").agg(F.sort_array(F.collect_list("c.p")).alias("ps"))
    percent = lambda x, share, more: ((x.cast("decimal(38,0)") * share + more) / 100).cast("decimal(38,6)")
    bounds = {"low": lambda x: F.ceil(percent(x, low, 0)).cast("long"), "high": lambda x: F.floor(percent(x, high, 0)).cast("long")}
    asked = cut_lineage(ask.join(scores, "q").withColumns({name: F.transform("ps", f) for name, f in bounds.items()}), "windows")
    hard = first_in_windows(asked.drop("ps"), tiles, boxes, negatives, False)
    found = hard.join(asked.select("q", "ps"), "q").select(F.struct("q", F.col("ps")[F.col("w")].alias("p")).alias("c"), "rank", "id", "score")
    lists = found.groupBy("c").agg(F.collect_list(F.struct("rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))).alias("_list"))
    left, right = spread_over(pairs, "c", windows.join(lists, "c"), "n", ["anchor_id", "positive_id"])
    return left.join(right, ["c", "_salt"]).select("anchor_id", "positive_id", F.col("c.p").alias("positive_score"), F.explode("_list").alias("z")).select(
        "anchor_id", "positive_id", "z.rank", "z.negative_id", "positive_score", "z.negative_score")
