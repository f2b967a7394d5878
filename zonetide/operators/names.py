"""Similarity joins of names, and names that occur in texts.

Two lists of names meet on shared elements, not pair by pair.  An element is a run of
one or two characters with its number among equal ones, so a name is a set and the
overlap of two sets is that of their letters.  A similarity of ``least`` bounds the
lengths of a pair and the overlap from below; with elements in one order, rare ones
first, two sets of enough overlap share one of their first elements.  Candidates are
then scored in tasks.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.session import cut_lineage, spread_by

GRAM = 3  # characters that names and texts must share
TINY = 1e-9


@dataclass(frozen=True)
class Ratio:
    """2 M / (n + m) of the characters M in matching blocks, as ``difflib`` finds them.

    Blocks are parted by characters that match nothing, so there are at most
    n + m - 2 M + 1 of them, and each loses one pair of neighbours.
    """

    least: float

    def shortest(self, n: Column) -> Column:
        return n * (self.least / (2 - self.least))

    def letters(self, n: Column, m: Column) -> Column:
        return (n + m) * (self.least / 2)

    def neighbours(self, n: Column, m: Column) -> Column:
        return (n + m) * (1.5 * self.least - 1) - 1

    def longest(self, n: Column) -> Column:
        return n * ((2 - self.least) / self.least)

    def score(self, raw: str, official: str) -> Column:
        @F.pandas_udf("double")
        def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            matcher, known = difflib.SequenceMatcher(None), None
            for a, b in pairs:
                out = []
                for x, y in zip(a, b):
                    if y != known:  # a matcher indexes its second text once
                        matcher.set_seq2(y)
                        known = y
                    matcher.set_seq1(x)
                    out.append(matcher.ratio())
                yield pd.Series(out, dtype=float)

        return ratio(raw, official)


@dataclass(frozen=True)
class Distance:
    """1 - edits / longer length; one edit takes at most two pairs of neighbours."""

    least: float

    def shortest(self, n: Column) -> Column:
        return n * self.least

    def letters(self, n: Column, m: Column) -> Column:
        return F.greatest(n, m) * self.least

    def neighbours(self, n: Column, m: Column) -> Column:
        return F.greatest(n, m) * (2 * self.least - 1) - 1

    def longest(self, n: Column) -> Column:
        return n / self.least

    def score(self, raw: str, official: str) -> Column:
        return 1 - F.levenshtein(raw, official) / F.greatest(F.length(raw), F.length(official))


def folded(name: Column) -> Column:
    """Upper case without surrounding white space."""
    return F.upper(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))


def _numbered(name: str, width: int) -> tuple[Column, Column]:
    """Runs of ``width`` characters of a name, and (over those in ``_runs``) each with its number among equal ones."""
    last = F.length(name) - (width - 1)
    runs = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(name, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))
    number = lambda x, i: F.size(F.filter(F.slice(F.col("_runs"), F.lit(1), i + 1), lambda y: y == x))
    return runs, F.transform("_runs", lambda x, i: F.concat(x, F.lit("#"), number(x, i).cast("string")))


def _elements(names: DataFrame, name: str, width: int) -> DataFrame:
    runs, numbered = _numbered(name, width)
    return names.withColumn("_runs", runs).select(name, F.explode(numbered).alias("_e")).withColumn("_n", F.length(name))


def _first_elements(elements: DataFrame, name: str, order: DataFrame, rule: Ratio | Distance, width: int) -> DataFrame:
    """The rarest elements of each name, as many as can be needed to meet a partner."""
    n = F.col("_n")
    if width == 1:
        need = rule.letters(n, rule.shortest(n))
    else:  # partners of which nothing is asked by neighbours meet by letters
        need = F.greatest(rule.neighbours(n, rule.shortest(n)), F.lit(1.0))
    size = n - (width - 1)
    first = size - F.ceil(need - TINY) + 1
    ranked = elements.join(order, "_e", "left").groupBy(name, "_n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_e").alias("e")))).alias("_all"))
    some = F.when(first >= 1, F.slice("_all", F.lit(1), F.greatest(first, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<struct<f:bigint,e:string>>"))
    return ranked.select(name, "_n", F.explode(some).alias("_x")).select(name, "_n", F.col("_x.e").alias("_e"))


def candidate_pairs(raw: DataFrame, official: DataFrame, rule: Ratio | Distance) -> DataFrame:
    """Distinct (a, b) of ``raw`` (a) and ``official`` (b), distinct names, that may reach ``rule.least``."""
    pairs = None
    for width in (2, 1):
        mine, theirs = _elements(raw, "a", width), _elements(official, "b", width)
        order = theirs.groupBy("_e").agg(F.count(F.lit(1)).alias("_f"))
        left = _first_elements(mine, "a", order, rule, width).withColumnRenamed("_n", "_na")
        right = _first_elements(theirs, "b", order, rule, width).withColumnRenamed("_n", "_nb")
        na, nb = F.col("_na"), F.col("_nb")
        by_neighbours = rule.neighbours(na, nb) >= 1 - TINY
        fits = (nb >= rule.shortest(na) - TINY) & (na >= rule.shortest(nb) - TINY) & (by_neighbours if width == 2 else ~by_neighbours)
        met = left.join(right, "_e").filter(fits).select("a", "b")
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.distinct()


BLOCK = 256  # names that meet as many others at once


def best_scores(mine: DataFrame, theirs: DataFrame, rule: Ratio | Distance) -> DataFrame:
    """(a, far): the best score of each name of ``mine`` (a) against all of ``theirs`` (b).

    Any pair may be the best, so all are scored: blocks of both lists meet, dealt over all tasks.
    """
    rows, columns = (names.count() // BLOCK + 1 for names in (mine, theirs))
    right = theirs.groupBy(F.pmod(F.xxhash64("b"), F.lit(columns)).alias("_j")).agg(F.collect_list("b").alias("_bs"))
    left = mine.groupBy(F.pmod(F.xxhash64("a"), F.lit(rows)).alias("_i")).agg(F.collect_list("a").alias("_as")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    pairs = spread_by(left.join(right, "_j"), "_i", "_j")
    met = pairs.select(F.explode("_as").alias("a"), "_bs").select("a", F.explode("_bs").alias("b"))
    return met.select("a", rule.score("a", "b").alias("s")).groupBy("a").agg(F.max("s").alias("far"))


def match_names(raw: DataFrame, column: str, official: DataFrame, name: str, rule: Ratio | Distance, inclusive: bool = True, scored: bool = False) -> DataFrame:
    """(column, matched, score) of each distinct raw name that is not null.

    Both sides are compared in upper case without surrounding blanks; ``matched`` is
    the official name as listed, of equal scores the smaller.  Equal names score 1.
    Where nothing reaches ``rule.least`` (or is above it), both are null.  Only distinct
    names and pairs that share rare elements are scored; lists of any length are joined.
    With ``scored`` a name without a match has its best score all the same, for which it
    meets every listed name.
    """
    if not 0 < rule.least <= 1:
        raise ValueError("the least similarity is above 0 and at most 1")
    names = raw.select(F.col(column).alias("_raw")).filter(F.col("_raw").isNotNull()).distinct().withColumn("a", folded(F.col("_raw")))
    listed = official.select(F.col(name).alias("_name")).filter(F.col("_name").isNotNull()).withColumn("b", folded(F.col("_name")))
    names, listed = cut_lineage(names, "names"), cut_lineage(listed.groupBy("b").agg(F.min("_name").alias("_name")), "listed")
    mine, theirs = names.select("a").distinct(), listed.select("b")
    same = mine.join(theirs, F.col("a") == F.col("b")).select("a", "b", F.lit(1.0).alias("s"))
    others = candidate_pairs(mine.join(theirs, F.col("a") == F.col("b"), "left_anti"), theirs, rule)
    pairs = others.select("a", "b", rule.score("a", "b").alias("s"))
    enough = F.col("s") >= rule.least if inclusive else F.col("s") > rule.least
    best = same.unionByName(pairs).filter(enough).join(listed, "b").groupBy("a").agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("_name").alias("n"))).alias("_w"))
    score = -F.col("_w.s")
    if not scored:
        return names.join(best, "a", "left").select(F.col("_raw").alias(column), F.col("_w.n").alias("matched"), score.alias("score"))
    best = cut_lineage(best, "best")
    rest = cut_lineage(mine.join(best, "a", "left_anti"), "rest")
    out = names.join(best, "a", "left").join(best_scores(rest, theirs, rule), "a", "left")
    return out.select(F.col("_raw").alias(column), F.col("_w.n").alias("matched"), F.coalesce(score, "far").alias("score"))


def _grams(text: str, width: int) -> Column:
    """Distinct runs of ``width`` characters, found in one walk over the text: a substring would walk from its start each time."""
    if not width:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1)))


def names_in_text(df: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` with ``found``, one for every listed name that occurs literally in the text, ignoring case.

    Each name is listed under the rarest of its runs of ``GRAM`` characters, a shorter
    one under itself; texts send their distinct runs once, whatever the length of the
    list, and the names met are looked for in the text.  Names are returned in upper
    case; null texts and names find nothing; an empty name is found in every text.
    """
    listed = names.select(F.upper(name).alias("found")).filter(F.col("found").isNotNull()).distinct()
    width = F.least(F.length("found"), F.lit(GRAM)).cast("int")
    runs = listed.select("found", width.alias("_w"), F.explode(F.when(F.length("found") > 0, _grams("found", GRAM)).otherwise(F.array(F.lit("")))).alias("_g"))
    short = listed.filter((F.length("found") < GRAM) & (F.length("found") > 0)).select("found", width.alias("_w"), F.col("found").alias("_g"))
    runs = runs.unionByName(short)
    counts = runs.groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    # written, so that its size is known before the runs of the texts are sent anywhere
    index = cut_lineage(runs.join(counts, "_g").groupBy("found", "_w").agg(F.min(F.struct("_f", "_g")).alias("_x")).select("found", "_w", F.col("_x._g").alias("_g")), "runs")
    widths = sorted(r["_w"] for r in index.select("_w").distinct().collect())  # at most GRAM + 1 values
    if not widths:
        return df.withColumn("found", F.lit(None).cast("string")).limit(0)
    keyed = df.withColumn("_text", F.upper(text)).withColumn("_key", F.sha2("_text", 256))
    sent = keyed.select("_key", F.explode(F.flatten(F.array(*(_grams("_text", w) for w in widths)))).alias("_g"))
    met = sent.join(index.select("found", "_g"), "_g").select("_key", "found").distinct()
    return keyed.join(met, "_key").filter(F.col("_text").contains(F.col("found"))).select(*df.columns, "found")
