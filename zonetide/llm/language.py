"""Language identification by word-first backoff.

A known word counts by its log frequency in each language, an unseen one by the mean
of its longest known character n-grams.  The model holds hashes in order and one
row of logarithms for each, so a task looks the distinct words of a slice of texts up
at once; it knows every word and n-gram that comes twice in the sample.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.textscan import Prefix, release, slices, spread
from zonetide.session import cut_lineage

ROWS_PER_LANGUAGE = 2500
LONGEST = 4
SMOOTH = 0.5
SLICE = 1 << 18  # bytes of text looked up at once
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


class Table(NamedTuple):
    """Log frequencies by language (columns) of the items with these hashes, in ascending order."""

    hashes: np.ndarray
    logs: np.ndarray

    def rows(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, row of each): the row is of use where the item is known."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, at


class Model(NamedTuple):
    """``words`` and ``grams`` (by length less one) have a column for each of ``languages``."""

    languages: list[str]
    words: Table
    grams: list[Table]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 0 outside words, 1 inside, 2 a letter."""
    every = np.arange(0x110000)
    every = every[(every < 0xD800) | (every > 0xDFFF)]
    out = np.zeros(0x110000, np.uint8)
    text = every.astype("<u4").tobytes().decode("utf-32-le")
    for m in _WORD.finditer(text):
        out[every[m.start() : m.end()]] = 1
    out[every[[c.isalpha() for c in text]]] += 1
    return np.minimum(out, 2)


def _points(texts: Sequence[str], before: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds) of texts, each after ``before``."""
    joined = before + before.join(texts) if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    return codes, np.append(0, np.cumsum([len(t) + len(before) for t in texts], dtype=np.int64))


def _hashes(items: Sequence[str]) -> np.ndarray:
    codes, bounds = _points(items)
    return Prefix(codes.astype(np.uint64)).of(bounds[:-1] + 1, bounds[1:])


def _grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def labelled_sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(text, lang): about ``rows`` labelled documents of each language, by a hash of doc_id; all where there are fewer."""
    known = docs.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    # a row per language, written so that Spark knows its size and need not shuffle texts to join it
    rate = cut_lineage(known.groupBy("lang").agg((F.lit(float(rows)) / F.count(F.lit(1))).alias("_rate")), "rates")
    return known.join(rate, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("_rate") * (1 << 20)).select("text", "lang")


def train(sample: DataFrame) -> Model:
    """Model of a bounded sample (text, lang).

    Counts are Spark aggregations over words, then over the character n-grams of
    the counted words.  Every word of a language and every n-gram that comes twice is
    kept, with its counts in all languages, so the model is as bounded as the sample
    and can go to every task.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                counts[lang].update(_WORD.findall(text.lower()))
            flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            yield pa.RecordBatch.from_pylist([{"lang": a, "item": b, "n": c} for a, b, c in flat], schema=_ITEMS)
        release()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, w, n in zip(batch["lang"].to_pylist(), batch["item"].to_pylist(), batch["n"].to_pylist()):
                for k in range(1, LONGEST + 1):
                    for g in _grams(w, k):
                        counts[lang, g] += n
            yield pa.RecordBatch.from_pylist([{"lang": a, "item": g, "n": n} for (a, g), n in counts.items()], schema=_ITEMS)
        release()

    total = F.sum("n").alias("n")
    by_word = cut_lineage(sample.mapInArrow(words, _ITEMS_SQL).groupBy("lang", "item").agg(total), "words")
    by_gram = cut_lineage(by_word.mapInArrow(grams, _ITEMS_SQL).groupBy("lang", "item").agg(total), "grams")
    sizes = by_word.groupBy("lang").agg(total).collect()  # one row per language
    languages = sorted(r.lang for r in sizes)
    return Model(languages, _table(by_word, languages), [_table(by_gram.filter(F.length("item") == k), languages) for k in range(1, LONGEST + 1)])


_ITEMS = pa.schema([("lang", pa.string()), ("item", pa.string()), ("n", pa.int64())])
_ITEMS_SQL = "lang string, item string, n long"


def _table(counts: DataFrame, languages: list[str]) -> Table:
    """Table of the items (lang, item, n) that come twice in all."""
    per = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(languages)]
    rows = counts.groupBy("item").agg(F.sum("n").alias("_all"), *per).filter("_all > 1").drop("_all").toArrow()
    found = np.stack([rows[f"n{i}"].to_numpy() for i in range(len(languages))], axis=1).astype(float) if languages else np.zeros((0, 0))
    hashes = _hashes(rows["item"].to_pylist())
    order = np.argsort(hashes)
    logs = np.log(found + SMOOTH) - np.log(found.sum(axis=0) + SMOOTH * (len(found) + 1))
    return Table(hashes[order], logs[order])


def _scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(has a letter, log likelihood by language) of each text."""
    codes, bounds = _points(texts)
    kind = _kinds()[codes]
    inside = np.append(kind > 0, False)
    edge = np.flatnonzero(inside != np.append(False, inside[:-1]))
    start, end = edge[::2], edge[1::2]
    letters = np.append(0, np.cumsum(kind == 2))
    lettered = letters[bounds[1:]] > letters[bounds[:-1]]
    values, first, which = np.unique(Prefix(codes.astype(np.uint64)).of(start, end), return_index=True, return_inverse=True)
    known, at = model.words.rows(values)
    logs = np.zeros((len(values), len(model.languages)))
    logs[known] = model.words.logs[at[known]]
    unseen = np.flatnonzero(~known)
    logs[unseen] = _backoff(model, [codes[start[i] : end[i]] for i in first[unseen]])
    total = np.zeros((len(texts), len(model.languages)))
    begin = np.searchsorted(start, bounds)
    some = np.flatnonzero(begin[1:] > begin[:-1])  # texts with words
    if len(some):
        total[some] = np.add.reduceat(logs[which], begin[some], axis=0)
    return lettered, total


def _backoff(model: Model, words: list[np.ndarray]) -> np.ndarray:
    """Mean log frequencies of the longest known n-grams of each word; zeros where none is known."""
    out = np.zeros((len(words), len(model.languages)))
    if not words:
        return out
    left, right = np.array([ord("<")], "<u4"), np.array([ord(">")], "<u4")
    size = np.array([len(w) for w in words])
    prefix = Prefix(np.concatenate([x for w in words for x in (left, w, right)]).astype(np.uint64))
    head = np.append(0, np.cumsum(size + 2))[:-1]
    open_ = np.ones(len(words), bool)
    for n in range(LONGEST, 0, -1):
        marks = n > 1
        number = np.where(open_, np.maximum(size + 2 * marks - n + 1, 0), 0)
        owner, at = spread(number)
        start = head[owner] + at + (not marks)
        known, row = model.grams[n - 1].rows(prefix.of(start, start + n))
        owner, row = owner[known], row[known]
        times = np.bincount(owner, minlength=len(words))
        np.add.at(out, owner, model.grams[n - 1].logs[row])
        done = times > 0
        out[done] /= times[done, None]
        open_ &= ~done
    return out


def predict(docs: DataFrame, model: Model, column: str = "_lang") -> DataFrame:
    """``docs`` with a struct ``column``: lang, the language of ``text``, and score, its share of the likelihood.

    Known words count by their log frequency in each language, unseen words by
    their character n-grams from the longest length that is known.  A null text and
    one without a letter is ``und`` with score 0, as is every text if nothing was
    learned.  Equal likelihoods go to the first language by name, so a text without
    usable evidence has that one and an even share.  Only the text is looked at;
    repeated rows and other columns pass through (a column named ``column`` is
    replaced); an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        model = sent.value
        langs, shares = [], []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), size=SLICE):
            lower = [(t or "").lower() for t in part["text"].to_pylist()]
            if not model.languages:
                langs += [UNKNOWN] * len(lower)
                shares += [0.0] * len(lower)
                continue
            lettered, total = _scores(model, lower)
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total[np.arange(len(total)), best][:, None]).sum(axis=1)
            langs += [model.languages[b] if known else UNKNOWN for b, known in zip(best.tolist(), lettered)]
            shares += np.where(lettered, share, 0.0).tolist()
        release()  # an executor keeps idle workers
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(shares, pa.float64())], fields=list(kind))

    return docs.withColumn(column, of("text"))
