"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.llm.columns import fresh
from zonetide.llm.ordered import running_total
from zonetide.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, weight, target) of a table (source, size).

    Sources by code point, null last, take ``weights`` in turn and share ``share``
    of all words; no target exceeds ``repeats`` times its source.  Sources reach
    their limit in the order of limit over weight, so the common level of the rest
    follows from sums in that order: one row per source, no iteration.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1))
    limit = F.col("source_size") * repeats
    full = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(rest)
    table = table.withColumn("_level", F.when(level <= limit / F.col("weight"), level))
    common = F.max("_level").over(everything)
    return table.withColumn("target", F.coalesce(F.least(common * F.col("weight"), limit.cast("double")), limit.cast("double"))).drop("_level")


def mixed_stream(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(rows, stream): every row of ``docs`` with its size and its source's target, and the mix in order.

    Each source queues its documents in the order of a seeded hash, ``repeats``
    times over.  A queued document is served until its virtual finish time, the
    words of its source up to its end over the source's weight; the stream is
    range-sorted by that time and stops at the total budget.  Sources are served at
    the same pace per weight, so at the stop the document in service of each source
    is cut short and every source has its target, to the nearest word.

    ``rows`` has _row, doc_id, source, size, source_size, target; ``stream`` has
    _row, doc_id, round, finish, at (words of the mix before it), words.
    """
    shuffle = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = cut_lineage(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
        .withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", shuffle), "sizes",
    )
    targets = cut_lineage(source_targets(sizes.select("source", "size"), weights, share, repeats), "targets")
    named = targets.withColumnRenamed("source", "_source")
    queue = running_total(sizes, ["source"], ["_key", "doc_id", "size", "_row"], "size", "_before")
    rows = cut_lineage(queue.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "queue")
    start = F.col("_before") + F.col("round") * F.col("source_size")
    end = F.least(start + F.col("size"), F.round("target").cast("long"))
    served = (
        rows.withColumn("round", F.explode(F.array(*[F.lit(i).cast("long") for i in range(repeats)])))
        .withColumn("words", end - start).filter("words > 0")
        .select("_row", "doc_id", "source", "round", "_key", (end / F.col("weight")).alias("finish"), "words")
    )
    budget = targets.agg(F.sum(F.round("target").cast("long"))).first()[0] or 0
    stream = running_total(served, [], ["finish", "source", "_key", "_row"], "words", "at")
    stream = stream.filter(F.col("at") < budget).withColumn("words", F.least("words", F.lit(budget) - F.col("at")))
    return rows.select("_row", "doc_id", "source", "size", "source_size", "target"), stream.select("_row", "doc_id", "round", "finish", "at", "words")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source, ...).

    ``taken`` counts the words that the mix takes from the document, repeats
    included; it never exceeds ``repeats`` times the size.  A null or empty text has
    size 0 and is never taken; null sources are one source, the last; repeated rows
    queue one after the other; an empty table gives no rows; other columns are
    ignored.  Reruns agree: the order of a queue depends on doc_id and seed alone.
    """
    rows, stream = mixed_stream(docs, weights, share, repeats, seed)
    taken = stream.groupBy("_row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "_row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "") -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole, once per round in which at least half of them is served.

    The columns are those of ``docs``, whatever their names.  A row with null doc_id is not taken.
    """
    rows, stream = mixed_stream(docs, weights, share, repeats, seed)
    rounds = stream.join(rows.select("_row", "size"), "_row").filter(F.col("words") * 2 >= F.col("size")).groupBy("_row", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    own, n = fresh(docs, "_id", "_n")
    times = rounds.groupBy(F.col("doc_id").alias(own)).agg(F.max("n").cast("int").alias(n))
    joined = docs.join(times, F.col("doc_id") == F.col(own))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
