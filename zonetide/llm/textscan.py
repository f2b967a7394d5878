"""Numpy helpers that tasks use on Arrow batches of texts.

Hashes are polynomial prefix hashes modulo the prime 2**61 - 1, finished by a mixing
step, so the hash of any run of symbols costs two look-ups.  Batches are cut into slices
of ``SLICE_BYTES`` of text; that bounds the memory of a task and changes no result.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
PRIME = (1 << 61) - 1
BASE = 0x9E3779B97F4A7C15 % PRIME
STEP = 1 << 15  # values multiplied at once, so that what lies between stays small
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P, _HALF, _LOW31, _LOW30, _LOW32 = (np.uint64(x) for x in (PRIME, 31, (1 << 31) - 1, (1 << 30) - 1, (1 << 32) - 1))


def residue(x: np.ndarray) -> np.ndarray:
    """Values modulo ``PRIME``."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo ``PRIME`` of values below it."""
    a, b = np.broadcast_arrays(a, b)
    out = np.empty(len(a), np.uint64)
    for i in range(0, len(a), STEP):
        x, y = a[i : i + STEP], b[i : i + STEP]
        xh, xl, yh, yl = x >> _HALF, x & _LOW31, y >> _HALF, y & _LOW31
        mid = xl * yh + xh * yl
        out[i : i + STEP] = residue(((xh * yh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & _LOW30) << _HALF) + xl * yl)
    return out


def running(x: np.ndarray) -> np.ndarray:
    """Running sums modulo ``PRIME`` of values below it, from 0 on."""
    out = np.zeros(len(x) + 1, np.uint64)
    high, low = np.cumsum(x >> np.uint64(32)), np.cumsum(x & _LOW32)  # below 2**63 each for 2**31 values
    high = residue(high)
    out[1:] = residue(residue(((high << np.uint64(32)) & _P) + (high >> np.uint64(29))) + residue(low))
    return out


BYTE_CODE = np.arange(1, 257, dtype=np.uint64)
LEAST_POWERS = 1 << 16
SMALL, FEW = 256, 1 << 24  # so many products of codes and half powers add up within 64 bits


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:
        some = min(done, size - done)
        out[done : done + some] = times(out[:some], np.uint64(pow(base, done, PRIME)))
        done += some
    return out


#: The powers asked for so far; smaller slices need fewer.
_known: dict[str, np.ndarray] = {}

#: What tasks keep between batches; workers serve one operator after another.
KEPT: list[dict] = [_known]


def release() -> None:
    """Give back what earlier tasks of this worker left in memory."""
    for kept in KEPT:
        kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    if n > len(_known.get("up", ())):
        size = max(LEAST_POWERS, 1 << (n - 1).bit_length())
        _known["up"], _known["down"] = _powers(BASE, size), _powers(pow(BASE, -1, PRIME), size)
    return _known["up"], _known["down"]


def released(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``f`` over a group, with memory given back before it and once more when nothing of it is held: an executor keeps idle workers."""

    def of(table: pa.Table) -> pa.Table:
        release()
        out = f(table)
        release()
        return out

    return of


class Prefix:
    """Hashes of runs of a sequence of 64-bit codes.

    Small codes, as those of bytes, are summed with both halves of the powers and
    reduced where a run is asked for; other codes are reduced at once.
    """

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        up = up[: len(codes)]
        self.halves = len(codes) <= FEW and int(codes.max(initial=0)) <= SMALL
        if self.halves:
            self.high, self.sums = np.zeros(len(codes) + 1, np.uint64), np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * (up >> _HALF), out=self.high[1:])
            np.cumsum(codes * (up & _LOW31), out=self.sums[1:])
        else:
            self.sums = running(times(residue(codes), up))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of codes[start:end] for arrays of bounds."""
        if self.halves:
            high = residue(self.high[end] - self.high[start])
            raw = residue(((high << _HALF) & _P) + (high >> np.uint64(30)) + residue(self.sums[end] - self.sums[start]))
        else:
            raw = residue(self.sums[end] + (_P - self.sums[start]))
        return mixed(times(raw, self.down[start]) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A number for every window of ``k`` codes, by start.

    Equal windows have equal numbers; a rare pair of others may share one too, so
    this serves to choose and to group, never to tell that windows are equal.
    """
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, begun, block, width, factor = np.zeros(n, np.uint64), 0, codes, 1, 0x9E3779B97F4A7C15
    while True:
        if k & width:
            out = out * np.uint64(factor) + block[begun : begun + n]
            begun += width
        if begun == k:
            return mixed(out)
        block = block[:-width] * np.uint64(factor) + block[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``size`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    ends = buffers(batch[column])[1][1:]
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts: byte bounds, hashes, and the bounds of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        solid = ~WHITE[data]
        first = np.zeros(len(data) + 1, bool)  # starts of texts cut words
        first[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = solid[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = solid[1:]
        self.starts = np.flatnonzero(solid & (~before | first[:-1]))
        self.ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        self.hashes = Prefix(BYTE_CODE[LOWER[data] if lower else data]).of(self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, offsets)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position in owner) of rows repeated ``counts`` times."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width``, by start."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def pieces(codes: np.ndarray, bounds: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Cut the windows of ``length`` symbols of each text into runs that share their least k-gram.

    Of the k-grams of least hash the first is taken.  It depends on the content of a
    window alone, so equal windows fall into runs of equal ``key``, and into
    different runs where a text repeats itself.  A run holds the windows that start
    at ``lo .. lo + count - 1`` of text ``row``; ``content`` is the hash of all
    symbols of the run.
    """
    empty = {c: np.zeros(0, np.int64) for c in ("row", "lo", "count")} | {c: np.zeros(0, np.uint64) for c in ("key", "content")}
    starts_of = np.maximum(np.diff(bounds) - length + 1, 0)
    if not starts_of.sum():
        return empty
    prefix = Prefix(codes)
    number = grams(codes, k)
    low = np.uint64(0xFFFFFFFF)  # upper half of the hash, then the position
    least = sliding_min((number & ~low) | np.arange(len(number), dtype=np.uint64), length - k + 1)
    row, at = spread(starts_of)
    start = bounds[:-1][row] + at
    chosen = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    return {
        "row": row[head], "lo": at[head], "count": count, "key": number[(chosen[head] & low).astype(np.int64)],
        "content": prefix.of(start[head], start[head] + count + length - 1),
    }
