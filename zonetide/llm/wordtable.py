"""Distinct-word tables: work once per distinct word, join the answers back by position.

Tasks split texts into words and pack a batch of documents as numbers into the
batch's own list of distinct words.  The lists are dealt by word over buckets, where
each distinct word gets its answer once; the answers return to their batches by a
join, and each document reads them at its positions.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.textscan import release, signed, slices
from zonetide.session import scratch_path

BATCH_BYTES = 48 << 20
BUCKET_WORDS = 200_000


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte position; the upper planes are nearly all zero."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_PACKED = "batch long, docs binary, sizes binary, numbers binary, times binary, n_words long, words array<binary>"
_PACKED_NAMES = ["batch", "docs", "sizes", "numbers", "times", "n_words", "words"]


def packed(docs: DataFrame, split: Callable[[], Callable[[str], list[str]]], frequencies: bool, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per batch of documents, written to the shared folder in buckets of ``batch``.

    ``numbers`` gives each document's words in order or, with ``frequencies``, its
    distinct words, which occur ``times``.  Smaller batches need less memory and
    repeat more words between them.
    """
    spark = docs.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cut, batch_no = split(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, size=batch_bytes):
                batch_no += 1
                number: dict[str, int] = defaultdict(count().__next__)
                found, times = [], []
                for text in part["text"]:
                    text = text.as_py()
                    doc = np.fromiter(map(number.__getitem__, cut(text)), "<u4") if text else np.zeros(0, "<u4")
                    if frequencies:
                        doc, n = np.unique(doc, return_counts=True)
                        times.append(n.astype("<u4"))
                    found.append(doc)
                ids = part["doc_id"].fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch_no], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.array([len(d) for d in found], "<u4").tobytes()], pa.binary()),
                    pa.array([planes(np.concatenate(found))], pa.binary()), pa.array([planes(np.concatenate(times)) if times else b""], pa.binary()),
                    pa.array([len(number)], pa.int64()), pa.array([[w.encode() for w in number]], pa.list_(pa.binary())),
                ], _PACKED_NAMES)
        release()  # an executor keeps idle workers

    rows = docs.select("doc_id", "text").mapInArrow(scan, _PACKED)
    path = scratch_path(spark, "words")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "batch").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def answered(table: DataFrame, answer: Callable[[], Callable[[str], bytes]]) -> DataFrame:
    """``table`` with a column ``answers``: (index, sizes, values) parts that give the answer of every word of the batch."""
    total = table.agg(F.sum("n_words")).first()[0] or 0
    buckets = 1 + total // BUCKET_WORDS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, words in zip(batch["batch"].to_pylist(), batch["words"]):
                words = words.values.to_pylist() if words.is_valid else []
                to = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1]))[: len(words)]
                parts = np.split(order, cuts[1:]) if len(words) else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(to[p[0]]) for p in parts], pa.int64()), pa.array([no] * len(parts), pa.int64()),
                    pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()), pa.array([[words[i] for i in p] for p in parts], pa.list_(pa.binary())),
                ], ["bucket", "batch", "index", "words"])

    def look_up(rows: pa.Table) -> pa.Table:
        release()
        of = answer()
        known: dict[bytes, bytes] = {}
        sizes, values = [], []
        for words in rows["words"]:
            got = []
            for w in words.values.to_pylist():
                if w not in known:
                    known[w] = of(w.decode())
                got.append(known[w])
            sizes.append(np.array([len(g) for g in got], "<u4").tobytes())
            values.append(b"".join(got))
        return pa.table({"batch": rows["batch"], "index": rows["index"], "sizes": pa.array(sizes, pa.binary()), "values": pa.array(values, pa.binary())})

    dealt = table.select("batch", "words").mapInArrow(deal, "bucket long, batch long, index binary, words array<binary>")
    back = dealt.groupBy("bucket").applyInArrow(look_up, "batch long, index binary, sizes binary, values binary")
    back = back.groupBy("batch").agg(F.collect_list(F.struct("index", "sizes", "values")).alias("answers"))
    return table.drop("words").join(back, "batch", "left")


def answers_of(row: dict) -> list[bytes]:
    """The answers of a batch's words, by their number."""
    out: list[bytes] = [b""] * row["n_words"]
    for part in row["answers"] or []:
        index, size = np.frombuffer(part["index"], "<u4").tolist(), np.frombuffer(part["sizes"], "<u4")
        end = np.cumsum(size)
        for i, a, b in zip(index, (end - size).tolist(), end.tolist()):
            out[i] = part["values"][a:b]
    return out


def documents_of(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, bounds of each document's numbers, numbers) of a batch."""
    ids = [None if i == -(1 << 63) else i for i in np.frombuffer(row["docs"], "<i8").tolist()]
    bounds = np.append(0, np.cumsum(np.frombuffer(row["sizes"], "<u4").astype(np.int64)))
    return ids, bounds, from_planes(row["numbers"])
