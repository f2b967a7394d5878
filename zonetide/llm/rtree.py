"""A packed R-tree over integer vectors, searched best first by inner product.

Points are tiled (sort-tile-recursive): cut into slabs along the dimension that
spreads most, each slab along the next, and so on, until runs of ``LEAF`` points are
left; runs of ``FANOUT`` nodes make the next level.  A node holds the least and the
greatest value of each coordinate, its least identifier and its label, of which there
is one: every label has trees of its own.  For a query the box gives an interval of the
inner product, coordinate by coordinate.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np

LEAF = 64
FANOUT = 16
FAR = 1 << 62


def kind_of(*parts: np.ndarray) -> type:
    """float64 where it holds every inner product of rows of ``parts`` exactly, else int64."""
    most = [int(np.abs(p).max(initial=0)) for p in parts]
    width = max(p.shape[-1] for p in parts)
    return np.float64 if width * math.prod(most) < 1 << 53 else np.int64


def intervals(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with a point of each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def tiled(x: np.ndarray, order: np.ndarray, dims: list[int]) -> list[np.ndarray]:
    """``order`` cut into runs of at most ``LEAF`` points that lie close together."""
    if len(order) <= LEAF:
        return [order]
    if not dims:
        return [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
    leaves = -(-len(order) // LEAF)
    slabs = math.ceil(leaves ** (1 / len(dims)))
    size = -(-leaves // slabs) * LEAF
    order = order[np.argsort(x[order, dims[0]], kind="stable")]
    return [run for i in range(0, len(order), size) for run in tiled(x, order[i : i + size], dims[1:])]


@dataclass
class Tree:
    """Nodes of all levels in one table; the children of a node, or the points of a leaf, lie side by side."""

    x: np.ndarray
    ids: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    least: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    leaf: np.ndarray
    roots: dict[object, list[int]]

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Tree:
        spread = x.astype(np.float64).var(axis=0) if len(x) else np.zeros(x.shape[1])
        dims = np.argsort(-spread, kind="stable").tolist()
        runs, cuts, roots = [], [], {}
        for label in np.unique(labels):
            points = np.flatnonzero(labels == label)
            mine = tiled(x, points, dims[: max(1, (-(-len(points) // LEAF)).bit_length() - 1)])  # two slabs a dimension at least
            cuts.append((label, len(mine)))
            runs += mine
        order = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        ends = np.cumsum([len(r) for r in runs], dtype=np.int64)
        begins = ends - [len(r) for r in runs] if runs else ends
        x, ids = x[order], ids[order]
        lo = [np.minimum.reduceat(x, begins)] if runs else []
        hi = [np.maximum.reduceat(x, begins)] if runs else []
        least, begin, end = ([np.minimum.reduceat(ids, begins)] if runs else []), [begins], [ends]
        total, at = len(runs), 0
        for label, n in cuts:
            first, level = at, n
            at += n
            while level > FANOUT:
                child = np.concatenate(begin), np.concatenate(lo), np.concatenate(hi), np.concatenate(least)
                b = np.arange(first, first + level, FANOUT)
                e = np.minimum(b + FANOUT, first + level)
                part = slice(first, first + level)
                lo.append(np.minimum.reduceat(child[1][part], b - first))
                hi.append(np.maximum.reduceat(child[2][part], b - first))
                least.append(np.minimum.reduceat(child[3][part], b - first))
                begin.append(b)
                end.append(e)
                first, level = total, len(b)
                total += level
            roots[label] = list(range(first, first + level))
        join = lambda parts, empty: np.concatenate(parts) if parts else empty
        none = np.zeros((0, x.shape[1]), x.dtype)
        return cls(x, ids, join(lo, none), join(hi, none), join(least, np.zeros(0, np.int64)), join(begin, ends), join(end, ends), np.arange(total) < len(runs), roots)

    def search(self, a: np.ndarray, nodes: list[int], low: list[int], high: list[int], floor: list[int | None], k: int) -> list[list[tuple[int, int]]]:
        """Per window [low, high] the first k of (score, id) below ``nodes``: higher scores first, then smaller ids.

        Nodes wait in a queue by their greatest score.  One is passed over if its interval
        misses every window or lies strictly below the k-th score known there (``floor``:
        the k-th score known elsewhere); at the k-th score itself it counts if it may hold
        a smaller id.
        """
        best: list[list[tuple[int, int]]] = [[] for _ in low]
        queue: list[tuple] = []

        def wanted(bottom: int, top: int, least: int) -> list[int]:
            out = []
            for w in range(len(low)):
                if top < low[w] or bottom > high[w]:
                    continue
                reach = min(top, high[w])
                if floor[w] is not None and reach < floor[w]:
                    continue
                if len(best[w]) == k and (-reach, least) > best[w][-1]:
                    continue
                out.append(w)
            return out

        def push(begin: int, nodes: np.ndarray) -> None:
            bottom, top = intervals(a[None], self.lo[nodes], self.hi[nodes])
            for j, (b, t) in enumerate(zip(bottom[0].tolist(), top[0].tolist())):
                node = int(nodes[j])
                least = int(self.least[node])
                if wanted(b, t, least):
                    heapq.heappush(queue, (-t, least, node, b))

        if nodes:
            push(0, np.array(nodes))
        while queue:
            top, least, node, bottom = heapq.heappop(queue)
            windows = wanted(bottom, -top, least)
            if not windows:
                continue
            begin, end = int(self.begin[node]), int(self.end[node])
            if not self.leaf[node]:
                push(begin, np.arange(begin, end))
                continue
            score = self.x[begin:end] @ a
            for w in windows:
                bar = low[w] if floor[w] is None else max(low[w], floor[w])
                if len(best[w]) == k:
                    bar = max(bar, -best[w][-1][0])
                hit = np.flatnonzero((score >= bar) & (score <= high[w]))
                if len(hit):
                    new = zip((-score[hit]).tolist(), self.ids[begin:end][hit].tolist())
                    best[w] = heapq.nsmallest(k, best[w] + [(int(s), i) for s, i in new])
        return [[(-s, i) for s, i in found] for found in best]
