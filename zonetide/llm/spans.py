"""Repeated spans: runs of windows compacted by content, and the parts that branch.

Both span operators start here.  Each text is cut into runs of windows that share
their least k-gram (:func:`~zonetide.llm.textscan.pieces`), so equal windows of two
texts lie in runs of equal key.  Runs of equal key and content collapse into their
first one; only keys with several contents need their windows looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.llm.textscan import Prefix, Words, buffers, mixed, pieces, release, signed, slices, spread
from zonetide.session import cut_lineage

#: texts -> (codes of their symbols, bounds of each text's symbols)
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]

_RUN = "doc_id long, lo long, count long, key long, content long, sure boolean"


def word_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as symbols, by their hash."""
    words = Words(*buffers(texts))
    return words.hashes, words.bounds


def runs(docs: DataFrame, symbols: Symbols, length: int, k: int, across: bool) -> DataFrame:
    """(doc_id, lo, count, key, content, sure): the runs of every text.

    Inside a slice of documents only the first run of a content stays open; the
    others are ``sure`` to repeat an earlier one and get a key of their own, so a
    passage that many documents share is a few rows per slice, not one per document.
    With ``across`` a repeat must lie in a document of larger id.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch):
                r = pieces(*symbols(part["text"]), length, k)
                doc = part["doc_id"].to_numpy(zero_copy_only=False)[r["row"]].astype(np.int64)
                order = np.lexsort((r["lo"], doc, r["content"], r["key"]))
                doc, lo, key, content = doc[order], r["lo"][order], r["key"][order], r["content"][order]
                new = np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1]))[: len(key)]
                head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                sure = doc > doc[head] if across else ~new
                key = np.where(sure, mixed(doc.view(np.uint64) ^ (lo.view(np.uint64) << np.uint64(32))), key)
                yield pa.RecordBatch.from_arrays(
                    [signed(doc), signed(lo), signed(r["count"][order]), signed(key), signed(content), pa.array(sure)],
                    ["doc_id", "lo", "count", "key", "content", "sure"],
                )
        release()  # an executor keeps idle workers

    return docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(scan, _RUN)


def compacted(found: DataFrame, length: int, across: bool) -> DataFrame:
    """(doc_id, lo, count, key, gone, weight): runs that repeat an earlier one, and runs that branch.

    ``gone`` runs repeat an earlier run as a whole.  The others are the first of
    their content below a key with several contents; ``weight`` is the number of
    symbols below the key.
    """
    key, same = ["sure", "key"], Window.partitionBy("sure", "key", "content").orderBy("doc_id", "lo")
    all_of_key = Window.partitionBy(*key)
    first = F.first("doc_id").over(same)
    later = F.col("doc_id") > first if across else (F.col("doc_id") > first) | (F.col("lo") > F.first("lo").over(same))
    return (
        found.withColumn("gone", F.col("sure") | later)
        .withColumn("branches", F.min("content").over(all_of_key) != F.max("content").over(all_of_key))
        .withColumn("weight", F.sum(F.when(~F.col("gone"), F.col("count") + (length - 1))).over(all_of_key))
        .filter("gone or branches").select("doc_id", "lo", "count", "key", "gone", "weight")
    )


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, runs) of the documents that have runs to look at."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "count", "key")).alias("runs"))
    return docs.select("doc_id", "text").filter("doc_id is not null").join(lists, "doc_id")


def _flat(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, count, key) of the runs of a batch."""
    lists = part["runs"]
    flat = lists.flatten()
    return (
        np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)),
        *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "count", "key")),
    )


def finer(docs: DataFrame, wanted: DataFrame, symbols: Symbols, length: int, k: int) -> DataFrame:
    """The wanted runs cut again by a longer k-gram, as :func:`runs` gives them; equal windows keep a key in common."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch):
                codes, bounds = symbols(part["text"])
                row, lo, count, key = _flat(part)
                size = count + (length - 1)
                owner, at = spread(size)
                r = pieces(codes[bounds[:-1][row[owner]] + lo[owner] + at], np.append(0, np.cumsum(size)), length, k)
                of = r["row"]
                doc = part["doc_id"].to_numpy(zero_copy_only=False)[row[of]]
                inner = mixed(r["key"] ^ key[of].view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [signed(doc), signed(lo[of] + r["lo"]), signed(r["count"]), signed(inner), signed(r["content"]), pa.array(np.zeros(len(of), bool))],
                    ["doc_id", "lo", "count", "key", "content", "sure"],
                )

    return with_texts(docs, wanted).mapInArrow(scan, _RUN)


def repeated_windows(docs: DataFrame, wanted: DataFrame, symbols: Symbols, length: int, across: bool) -> DataFrame:
    """(doc_id, lo, count): single windows of the wanted runs that start earlier too.

    Windows are counted by key and content hash; the first place of each is a
    grouped minimum with map-side combination, and Spark's skew join splits
    windows that very many runs hold.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codes, bounds = symbols(part["text"])
                prefix = Prefix(codes)
                row, lo, count, key = _flat(part)
                owner, at = spread(count)
                at = lo[owner] + at
                start = bounds[:-1][row[owner]] + at
                doc = part["doc_id"].to_numpy(zero_copy_only=False)[row[owner]]
                yield pa.RecordBatch.from_arrays(
                    [signed(doc), signed(at), signed(key[owner]), signed(prefix.of(start, start + length))], ["doc_id", "lo", "key", "window"]
                )

    windows = cut_lineage(with_texts(docs, wanted).mapInArrow(scan, "doc_id long, lo long, key long, window long"), "windows")
    place = F.struct("doc_id", "lo")
    first = windows.groupBy("key", "window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = F.col("doc_id") > F.col("first.doc_id") if across else place > F.col("first")
    return windows.join(first, ["key", "window"]).filter(later).select("doc_id", "lo", F.lit(1).cast("long").alias("count"))


def by_document(removed: DataFrame) -> DataFrame:
    """(doc_id, spans): runs of removed windows of each document."""
    return removed.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "count")).alias("spans"))


def covered(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Disjoint, ascending bounds of the symbols that the windows of ``spans`` cover."""
    lo = np.array([s["lo"] for s in spans], np.int64)
    end = lo + np.array([s["count"] for s in spans], np.int64) + (length - 1)
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.append(True, lo[1:] > end[:-1])
    return list(zip(lo[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)].tolist()))
