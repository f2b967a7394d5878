"""Substring dedup on words by compacted paths of windows.

The windows of ``length`` words are the edges of a De Bruijn graph.  A graph with a row
for every edge does not fit: at 24 bytes an edge it is several times the input for a
single shuffle.  So windows that follow one another and share their least k-gram are
taken as one path from the start; equal paths compact by a grouped join on their
content, and paths of one key that differ somewhere are taken apart into single
windows, whose first place tells whether a document of smaller id has them too.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.columns import fresh
from zonetide.llm.spans import by_document, compacted, covered, repeated_windows, runs, word_symbols
from zonetide.session import cut_lineage

LENGTH = 50
GRAM = 16


def repeated_word_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans): for each document the windows that a document of smaller id has too, as (lo, count) runs of words."""
    paths = cut_lineage(compacted(runs(docs, word_symbols, length, gram, across=True), length, across=True), "paths")
    edges = repeated_windows(docs, paths.filter("not gone"), word_symbols, length, across=True)
    return by_document(paths.filter("gone").select("doc_id", "lo", "count").unionByName(edges))


def without_repeated_words(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, column: str = "_cut") -> DataFrame:
    """``docs`` with a struct ``column``: n_words, n_removed and the kept words, joined by one space.

    Words are runs of non-white bytes, unchanged.  A word goes if it is covered by
    a window of ``length`` words that also starts in a document of smaller doc_id;
    windows are judged on the texts as given.  A null text has no words; a null
    doc_id keeps its words; rows that share a doc_id are one document; an empty
    table gives no rows; other columns pass through, whatever their names (one named
    ``column`` is replaced).
    """

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept: string>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, span in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist()):
            words = (text or b"").split()  # bytes split at the same six white characters
            kept = words
            if span:
                edge = [0, *(x for ab in covered(span, length) for x in ab), len(words)]
                kept = [w for a, b in zip(edge[::2], edge[1::2]) for w in words[a:b]]
            out.append({"n_words": len(words), "n_removed": len(words) - len(kept), "kept": b" ".join(kept)})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])).cast(
            pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        )

    docs = docs.drop(column)
    own, gone = fresh(docs, "_id", "_spans")
    spans = repeated_word_spans(docs, length, gram).select(F.col("doc_id").alias(own), F.col("spans").alias(gone))
    joined = docs.filter("doc_id is not null").join(spans, F.col("doc_id") == F.col(own), "left").withColumn(column, cut("text", gone)).drop(own, gone)
    none = F.lit(None).cast(dict(spans.dtypes)[gone])
    return joined.unionByName(docs.filter("doc_id is null").withColumn(column, cut("text", none)))
