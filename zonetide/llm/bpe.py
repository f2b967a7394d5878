"""BPE encoding, decoding and token counts through distinct-word tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.llm.splitting import as_bytes, splitter, tokenizer, word_ids
from zonetide.llm.textscan import release, signed
from zonetide.llm.wordtable import BATCH_BYTES, answered, answers_of, documents_of, from_planes, packed

OUT_BYTES = 4 << 20


def read_file(path: str) -> str:
    """Content of a tokenizer file, read on the driver and sent along with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def pieces(spark: SparkSession, file: str) -> DataFrame:
    """(id, piece) of a tokenizer's vocabulary, special tokens included."""
    vocab = tokenizer(file).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, p) for p, i in vocab.items()], "id int, piece string")


def encode(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, ids): ids of each text as little-endian unsigned 32-bit numbers.

    ``file`` is the content of a tokenizers file.  Texts are split into words in
    Spark, each distinct word is encoded once, and the ids come back by position.
    A null or empty text has no ids; a null doc_id is kept; repeated rows give one
    row each; an empty table gives no rows; other columns are ignored.
    """
    return _read_at_positions(docs, file, decoded=False)


def encode_decode(docs: DataFrame, file: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, ids, decoded): as :func:`encode`, and the pieces of the ids joined by one space.

    That is what the library gives for a file without decoder.  The id-to-piece
    table is as long as the vocabulary, so it goes to every task and the ids of each
    distinct word are joined with it there, once per batch.
    """
    return _read_at_positions(docs, file, decoded=True, batch_bytes=batch_bytes)


def _read_at_positions(docs: DataFrame, file: str, decoded: bool, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    def answer():
        ids = word_ids(file)
        return lambda word: as_bytes(ids(word))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        piece = {i: p.encode() for p, i in tokenizer(file).get_vocab(with_added_tokens=True).items()}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words = answers_of(row)
                text = [b" ".join([piece[j] for j in np.frombuffer(w, "<u4").tolist()]) for w in words] if decoded else []
                ids, bounds, numbers = documents_of(row)
                out, size = ([], [], []), 0
                for d, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist()):
                    at = numbers[a:b].tolist()
                    out[0].append(d)
                    out[1].append(b"".join(map(words.__getitem__, at)))
                    if decoded:
                        out[2].append(b" ".join(map(text.__getitem__, at)))
                    size += len(out[1][-1]) + (len(out[2][-1]) if decoded else 0)
                    if size > OUT_BYTES:
                        yield _out(out, decoded)
                        out, size = ([], [], []), 0
                yield _out(out, decoded)
        release()

    def _out(out, decoded: bool) -> pa.RecordBatch:
        arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())]
        if decoded:
            arrays.append(pa.array(out[2], pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"][: len(arrays)])

    table = packed(docs, lambda: splitter(file), frequencies=False, batch_bytes=batch_bytes)
    return answered(table, answer).mapInArrow(read, "doc_id long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``encoded`` (doc_id, ids array<int>) with ``decoded``: pieces joined by one space, through an id-to-piece join.

    For arbitrary id lists; ``vocabulary`` is the table of :func:`pieces`.  An empty
    or null list decodes to the empty text; ids outside the vocabulary are left out.
    """
    rows = encoded.withColumn("_row", F.monotonically_increasing_id())
    at = rows.select("_row", F.posexplode("ids").alias("_at", "id")).join(vocabulary, "id")
    text = at.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "piece"))).alias("_p")).select("_row", F.array_join("_p.piece", " ").alias("decoded"))
    return rows.join(text, "_row", "left").withColumn("decoded", F.coalesce("decoded", F.lit(""))).drop("_row")


def token_counts(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): bytes and tokens of each text, without making its ids.

    For byte-level files, whose pre-tokens cover the whole text.

    The pieces of each distinct pre-token are counted once; a document joins the
    counts to its pre-token frequencies and sums.  A null or empty text has none; a
    null doc_id is kept; repeated rows give one row each; an empty table gives no
    rows; other columns are ignored.
    """

    def answer():
        ids = word_ids(file)
        return lambda word: as_bytes([len(ids(word)), len(word.encode())])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                count = np.frombuffer(b"".join(answers_of(row)), "<u4").astype(np.int64).reshape(-1, 2)
                ids, bounds, numbers = documents_of(row)
                sums = np.zeros((len(numbers) + 1, 2), np.int64)
                np.cumsum(count[numbers] * from_planes(row["times"])[:, None], axis=0, out=sums[1:])
                sums = sums[bounds[1:]] - sums[bounds[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), signed(sums[:, 1]), signed(sums[:, 0])], ["doc_id", "n_bytes", "n_tokens"])

    table = packed(docs, lambda: splitter(file), frequencies=True)
    return answered(table, answer).mapInArrow(total, "doc_id long, n_bytes long, n_tokens long")
