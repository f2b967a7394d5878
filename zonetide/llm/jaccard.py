"""N-gram Jaccard join by vertical partitioning.

The global order of shingles (rarest first) is cut into fragments.  Each fragment
counts, apart from the others, how much of every document is shared; the sums per
document leave only those that can have a partner.  Candidates come from the
rarest part of each document, and the overlap of a pair is counted per fragment
and summed per pair.  Equal sets are one node throughout.

Sets are known by 64-bit hashes, of shingles and of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.components import components, grow_forest
from zonetide.llm.textscan import Prefix, Words, buffers, mixed, release, released, signed, slices, spread
from zonetide.session import cut_lineage

WIDTH = 5
PERCENT = 80
FRAGMENT_ROWS = 1 << 20  # shingles of one fragment in one task
SLICE = 1 << 18  # bytes of text hashed at a time; each takes some sixty times its size
SLICE_ROWS = 1 << 20  # shingles of the documents that go to a fragment in one row
COPY_BITS = 24
SEGMENTS = 4  # fragments in which the overlap of a pair is counted
TILE = 4096  # sets on one side of a task
TOKEN_BITS = 40


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles in document order, their number and a hash of each set."""
    data, offsets = buffers(texts)
    words = Words(data, offsets, lower=True)
    size = np.diff(words.bounds)
    doc, at = spread(np.where(size >= width, size - width + 1, np.minimum(size, 1)))
    start = words.bounds[:-1][doc] + at
    hashes = Prefix(words.hashes).of(start, start + np.minimum(size[doc], width))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    n = np.bincount(doc, minlength=len(size))
    sums = np.append(np.uint64(0), np.cumsum(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
    ends = np.cumsum(n)
    node = mixed((sums[ends] - sums[ends - n]) ^ mixed(n.astype(np.uint64)))
    return doc, hashes, n, node


def set_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, node): size and identity of each document's shingle set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                _, _, n, node = shingle_sets(part["text"], width)
                yield pa.RecordBatch.from_arrays([part["doc_id"], signed(n), signed(node)], ["doc_id", "n_shingles", "node"])
        release()

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_shingles long, node long")


def _pack(tokens: np.ndarray) -> bytes:
    """The low five bytes of each value."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _planes(x: np.ndarray) -> bytes:
    """The low byte of each number, then the second of each ...: the upper ones are zeros that compress."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _steps(docs: np.ndarray) -> bytes:
    """Ascending documents as steps from one to the next."""
    return _planes(np.diff(docs, prepend=docs[:0].dtype.type(0)))


def _docs(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw), dtype=np.int64)


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


_PACKED = "fragment int, slice long, docs binary, sizes binary, nodes binary, tokens binary, counts binary"
_NAMES = ["fragment", "slice", "docs", "sizes", "nodes", "tokens", "counts"]
_ARROW = pa.schema([("fragment", pa.int32()), ("slice", pa.int64())] + [(c, pa.binary()) for c in _NAMES[2:]])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


def copied_sets(sets: DataFrame) -> np.ndarray:
    """Bits by the low ``COPY_BITS`` of a node: set if some node of that kind belongs to several documents.

    A set of the table of :func:`set_table` without its bit has no copy for certain.
    The bits are of fixed size whatever the input; Spark makes them, 4 kB a row.
    """
    copied = sets.filter("n_shingles > 0").groupBy("node").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    bit = F.pmod("node", F.lit(1 << COPY_BITS)) + 1
    bits = copied.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros((1 << COPY_BITS) // 8, np.uint8)
    for row in bits.toLocalIterator():
        part = np.frombuffer(row.bits, np.uint8)
        at = (row.bucket - 1) * len(part)
        out[at : at + len(part)] = part
    return out


def packed_shingles(docs: DataFrame, sets: DataFrame, fragments: int, width: int = WIDTH) -> DataFrame:
    """The shingles of every text by slice of documents and fragment, and a row without shingles for each slice.

    Copies of a set inside a slice come once; of others only those that ``sets``, the
    table of :func:`set_table`, has several times say in each fragment which set they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(copied_sets(sets))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, size=SLICE):
                doc, hashes, n, node = shingle_sets(part["text"], width)
                held.append((doc.astype(np.uint32), hashes, n, node))
                size += len(hashes)
                if size >= SLICE_ROWS:
                    number += 1
                    yield _rows(packed(number, held))
                    held, size = [], 0
        if held:
            yield _rows(packed(number + 1, held))
        held = []
        release()  # an executor keeps idle workers

    def packed(number: int, held: list[tuple]) -> list[tuple]:
        """One row for the documents of a slice and one for each fragment that they have shingles in; empties ``held``."""
        n, node = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        first = np.zeros(len(n), bool)
        first[np.unique(node, return_index=True)[1]] = True
        first &= n > 0
        base = np.cumsum([0] + [len(h[2]) for h in held])
        place = (np.cumsum(first) - 1).astype(np.uint32)
        doc, hashes = [], []
        for i in range(len(held)):
            mine = held[i][0] + np.uint32(base[i])
            keep = first[mine]
            doc.append(place[mine[keep]])
            hashes.append(held[i][1][keep])
            held[i] = None
        doc, hashes = np.concatenate(doc), np.concatenate(hashes)
        n, node = n[first], node[first]
        kind = node & np.uint64((1 << COPY_BITS) - 1)
        copied = (sent.value[(kind >> np.uint64(3)).astype(np.int64)] >> (kind & np.uint64(7)).astype(np.uint8)) & 1 == 1
        fragment = ((hashes >> np.uint64(TOKEN_BITS)) % np.uint64(fragments)).astype(np.int32)
        order = np.argsort(fragment, kind="stable")
        doc, hashes, fragment = doc[order], hashes[order], fragment[order]
        rows = [(number % fragments, number, None, n.astype("<u4").tobytes(), node.tobytes(), None, None)]
        for lo, hi in _groups(fragment):
            mine = doc[lo:hi]
            named = mine[np.append(True, mine[1:] != mine[:-1])]
            rows.append((int(fragment[lo]), number, _steps(mine), None, node[named[copied[named]]].tobytes(), _pack(hashes[lo:hi]), np.packbits(copied[named]).tobytes()))
        return rows

    return docs.select("text").mapInArrow(cut, _PACKED)


def shared_shingles(docs: DataFrame, sets: DataFrame, fragments: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(node, n, tokens): sets of which at least ``percent`` is also in other sets, with the shared shingles, rarest first.

    A task packs the shingles of a slice of documents by fragment; a fragment
    counts in how many sets each of its shingles is and sends the shared ones back
    to the slice, where the parts of each document meet again.
    """

    def share(table: pa.Table) -> pa.Table:
        """Keep the shingles of a fragment that lie in two sets or more, with the number of sets."""
        parts = table.to_pylist()
        heads = [tuple(p[c] for c in _NAMES) for p in parts if p["tokens"] is None]
        parts = [p for p in parts if p["tokens"] is not None]
        if not parts:
            return pa.Table.from_batches([_rows(heads)])
        edge = np.cumsum([0] + [len(p["tokens"]) // 5 for p in parts])
        token = np.concatenate([_unpack(p["tokens"]) for p in parts])
        order = np.argsort(token, kind="stable")
        again = token[order]
        again = again[1:] == again[:-1]
        tied = order[np.append(again, False) | np.append(False, again)]  # shingles that occur again
        del order, again
        owner = []  # a set that is copied by its node, any other by its place
        for i, p in enumerate(parts):
            mine = _docs(p["docs"])
            new = np.append(True, mine[1:] != mine[:-1])
            who = (np.uint64(i + 1) << np.uint64(32)) | mine[new].astype(np.uint64)
            who[np.unpackbits(np.frombuffer(p["counts"], np.uint8), count=len(who)) == 1] = np.frombuffer(p["nodes"], np.uint64)
            owner.append(who[np.cumsum(new) - 1])
        v, t = np.concatenate(owner)[tied], token[tied]
        del owner
        by = np.lexsort((v, t))
        t, v, tied = t[by], v[by], tied[by]
        group = np.cumsum(np.append(True, t[1:] != t[:-1])[: len(t)]) - 1
        fresh = np.append(True, (v[1:] != v[:-1]) | (t[1:] != t[:-1]))[: len(t)]
        times = np.bincount(group, weights=fresh, minlength=1).astype(np.int64)
        sets = np.zeros(len(token), "<u4")
        sets[tied] = np.minimum(times[group], 0xFFFFFFFF) if len(t) else 0
        out = heads
        for p, lo, hi in zip(parts, edge[:-1], edge[1:]):
            hit = sets[lo:hi] > 1
            if hit.any():
                out.append((p["fragment"], p["slice"], _steps(_docs(p["docs"])[hit]), None, None, _pack(token[lo:hi][hit]), _planes(sets[lo:hi][hit])))
        return pa.Table.from_batches([_rows(out)])

    def gather(table: pa.Table) -> pa.Table:
        """Sum the partial counts of each document of a slice; keep those with enough."""
        parts = table.to_pylist()
        head = next(p for p in parts if p["tokens"] is None)
        n, node = np.frombuffer(head["sizes"], "<u4"), np.frombuffer(head["nodes"], np.int64)
        parts = [p for p in parts if p["tokens"] is not None]
        total = np.zeros(len(n), np.int64)
        for p in parts:
            total += np.bincount(_docs(p["docs"]), minlength=len(n))
        good = (total * 100 >= n * np.int64(percent)) & (n > 0) & (total > 0)
        doc, token, sets = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, "<u4")]
        for p in parts:
            d = _docs(p["docs"])
            keep = good[d]
            doc.append(d[keep])
            token.append(_unpack(p["tokens"])[keep] | np.uint64(p["fragment"] << TOKEN_BITS))
            sets.append(_from_planes(p["counts"])[keep])
        doc, token, sets = np.concatenate(doc), np.concatenate(token), np.concatenate(sets)
        order = np.lexsort((token, sets, doc))
        some = np.flatnonzero(good)
        offsets = np.append(0, np.cumsum(total[some])).astype(np.int32)
        return pa.table({
            "node": pa.array(node[some]), "n": signed(n[some]),
            "tokens": pa.ListArray.from_arrays(pa.array(offsets), signed(token[order])),
        })

    shared = packed_shingles(docs, sets, fragments, width).groupBy("fragment").applyInArrow(released(share), _PACKED)
    return shared.groupBy("slice").applyInArrow(released(gather), "node long, n long, tokens array<long>").dropDuplicates(["node"])


def _groups(key: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    return list(zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist()))


def _rare(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, s, token, index, band): the rarest shingles of each set.

    A linked pair shares one among the rarest of the longer set (1 + n - percent of
    n) and of the shorter (1 + n - 2 percent / (100 + percent) of n; ``index``).
    Sizes of linked sets fall into one band or into neighbouring ones.
    """
    n, s = F.col("n"), F.size("tokens")
    long = n - F.ceil(n * percent / 100) + 1 - (n - s)
    short = n - F.ceil(n * 2 * percent / (100 + percent)) + 1 - (n - s)
    return sets.select(
        "node", "n", s.alias("s"), short.alias("short"),
        F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("long").alias("band"),
        F.posexplode(F.slice("tokens", 1, F.greatest(long, F.lit(0)).cast("int"))).alias("at", "token"),
    ).select("node", "n", "s", "band", "token", (F.col("at") < F.col("short")).alias("index"))


def _meeting(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Rows (x, y, both) for each shared rare shingle of two sets, x the shorter, that can link by their sizes."""
    both = F.col("x_n") + F.col("n")
    reach = y.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    return (
        x.join(reach, ["token", "band"])
        .filter((F.struct("x_n", "x_node") < F.struct("n", "node")) & (F.col("x_n") * 100 >= F.col("n") * percent))
        .filter(F.least("x_s", "s") * (100 + percent) >= both * percent)  # the overlap is within the shared parts
        .withColumn("both", both)
    )


def _within_clusters(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """(x, y): a spanning forest of the links inside each cluster.

    Tasks hold two tiles of a cluster, count the shared shingles of their pairs
    fragment by fragment, sum per pair, and return trees instead of pairs.
    """
    sized = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("long").alias("tiles"))
    placed = clusters.join(sized, "cluster").join(sets, "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "cluster", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), (F.col("tile") > F.col("other")).alias("second"), "node", "n", "tokens",
    )

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, n, second = (table[c].to_numpy() for c in ("node", "n", "second"))
        lists = table["tokens"].combine_chunks()
        size = lists.value_lengths().to_numpy()
        token, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), size)
        side = np.flatnonzero(~second)
        others = np.flatnonzero(second) if table["left"][0].as_py() != table["right"][0].as_py() else side
        parent = np.arange(len(node))
        first = ~second[owner]
        by = np.lexsort((owner[first], token[first], token[first] % SEGMENTS))
        posted, holder = token[first][by], owner[first][by]
        edge = np.searchsorted(posted % SEGMENTS, np.arange(SEGMENTS + 1))
        fragments = [(posted[a:b], holder[a:b]) for a, b in zip(edge[:-1], edge[1:])]
        ends = np.cumsum(size)
        for y in others.tolist() if len(side) else ():
            mine = token[ends[y] - size[y] : ends[y]]
            overlap = np.zeros(len(node), np.int64)
            for v, (tokens, holders) in enumerate(fragments):
                part = mine[mine % SEGMENTS == v]
                low = np.searchsorted(tokens, part)
                row, at = spread(np.searchsorted(tokens, part, "right") - low)
                overlap += np.bincount(holders[low[row] + at], minlength=len(node))
            linked = np.flatnonzero((overlap * (100 + percent) >= percent * (n + n[y])) & (overlap > 0))
            linked = linked[linked != y]
            grow_forest(parent, linked, np.full(len(linked), y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        hit = parent != np.arange(len(node))
        return pa.table({"x": signed(node[parent[hit]]), "y": signed(node[hit])})

    return tiled.groupBy("cluster", "left", "right").applyInArrow(count, "x long, y long")


def linked_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the sets that link with another one.

    ``sets`` is the table of :func:`shared_shingles`.  Sets meet by their rare
    shingles.  At first each set meets one representative, of those of its rare
    shingles the one that most of them have; that makes clusters, whose pairs are
    counted inside tasks, so near copies of one text join up without a row per pair.
    Then every pair that lies in two clusters and two components is counted, by
    fragments that are summed per pair.
    """
    rare = cut_lineage(_rare(sets, percent), "rare")
    named = [F.col(c).alias(f"x_{c}") for c in ("node", "n", "s")]
    head = rare.filter("index").groupBy("token", "band").agg(F.min(F.struct("n", "node", "s")).alias("h")).select("token", "band", "h.*")
    meet = _meeting(head.select("token", "band", *named), rare, percent)
    best = (
        meet.groupBy(F.col("x_node").alias("x"), F.col("node").alias("y")).agg(F.count(F.lit(1)).alias("k"))
        .groupBy("y").agg(F.max(F.struct("k", "x")).alias("b")).select("b.x", "y")
    )
    clusters = cut_lineage(components(best, "x", "y").withColumnRenamed("component", "cluster"), "clusters")
    links = cut_lineage(_within_clusters(sets, clusters, percent), "links")
    found = components(links, "x", "y")
    now = (
        rare.join(clusters, "node", "left").join(found, "node", "left")
        .withColumn("cluster", F.coalesce("cluster", "node")).withColumn("comp", F.coalesce("component", "node")).drop("component")
    )
    index = now.filter("index").select("token", "band", *named, F.col("cluster").alias("x_cluster"), F.col("comp").alias("x_comp"))
    across = _meeting(index, now.drop("index"), percent).filter((F.col("x_cluster") != F.col("cluster")) & (F.col("x_comp") != F.col("comp")))
    pairs = cut_lineage(across.groupBy(F.col("x_node").alias("x"), F.col("node").alias("y")).agg(F.first("both").alias("both")), "pairs")
    if pairs.isEmpty():
        return found
    met = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    parts = sets.join(met, "node", "left_semi").select("node", F.explode(F.transform(F.array(*[F.lit(i) for i in range(SEGMENTS)]), lambda i: F.struct(
        i.alias("part"), F.filter("tokens", lambda t: F.pmod(t, F.lit(SEGMENTS)) == i).alias("tokens")))).alias("p"))
    parts = parts.select("node", "p.part", "p.tokens").filter(F.size("tokens") > 0)
    partial = (
        pairs.join(parts.select(F.col("node").alias("x"), "part", F.col("tokens").alias("tx")), "x")
        .join(parts.select(F.col("node").alias("y"), "part", F.col("tokens").alias("ty")), ["y", "part"])
        .select("x", "y", "both", F.size(F.array_intersect("tx", "ty")).cast("long").alias("o"))
    )
    more = partial.groupBy("x", "y").agg(F.first("both").alias("both"), F.sum("o").alias("o")).filter(F.col("o") * (100 + percent) >= F.col("both") * percent)
    return components(links.unionByName(more.select("x", "y")), "x", "y")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text, ...).

    Words are runs of non-white bytes, A-Z lower-cased; a set holds the distinct
    runs of ``width`` words, or the whole sequence if it is shorter.  Two documents
    link when percent of their union is shared.  ``component_id`` is the least
    doc_id reached.  A null or empty text has no shingles and its own id; equal sets
    always link; rows with one doc_id are nodes of their own that keep the id;
    an empty table gives no rows; other columns are ignored.
    """
    sets = cut_lineage(set_table(docs, width), "sets")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    shared = cut_lineage(shared_shingles(docs, sets, 1 + total // FRAGMENT_ROWS, width, percent), "shared")
    label = linked_sets(shared, percent)
    first = sets.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    first = first.join(label, "node", "left").withColumn("label", F.coalesce("component", "node"))
    least = first.groupBy("label").agg(F.min("first").alias("component"))
    to = first.select("node", "label").join(least, "label").select("node", F.col("component").alias("_c"))
    return sets.join(to, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("_c", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
