"""Exact dedup by a stream with keyed state.

A Structured Streaming query takes the files of a table in, batch after batch, and
keeps per digest of a text the greatest identifier, the locator of that row (file and
row in the file) and the number of rows.  The state lies on disk (RocksDB, committed
to the shared folder) and never expires, so a later run with the same log takes in
only files it has not seen.  The state is then read as a table; rows whose digest
occurs more than once are hits, and their full bytes are compared.  Everything is
DataFrame functions; no text passes through the driver, and the state holds none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zonetide.llm.skew import spread_over
from zonetide.session import cut_lineage, scratch_path

_STORE = "spark.sql.streaming.stateStore"
STATE_CONF = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "256",
    f"{_STORE}.rocksdb.allowFAllocate": "false",  # each of many small stores would claim megabytes of disk ahead
}


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _rows(source: DataFrame, id_: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    place = F.struct(F.col(id_).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return source.select(digest(content).alias("digest"), content.alias("content"), place.alias("at"))


def _exactly(path: str) -> str:
    """A pattern that only ``path`` matches; a stream reads a single file only by pattern."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/{{{name}}}" if folder else f"{{{name}}}"


def _committed(spark: SparkSession, log: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/commits")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(place) and len(store.listStatus(place)) > 0


def _schema(spark: SparkSession, path: str, id_: str, text: str) -> StructType:
    """The two columns read; left alone, a column named ``_metadata`` would hide the place of a row."""
    return spark.read.parquet(path).select(id_, text).schema


def take_in(spark: SparkSession, path: str, log: str, id_: str = "doc_id", text: str = "text",
            digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """Take the Parquet files at ``path`` into the state of ``log``; the state as (digest, at, n).

    ``at`` is the greatest (id, file, row) of the digest and ``n`` counts its rows.  A
    run with a log of an earlier run goes on after the files that one took in, also
    after a failure; the digest must be the same.  No files give no rows.
    """
    schema = _schema(spark, path, id_, text)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = _rows(reader.parquet(_exactly(path)), id_, text, digest)
    state = rows.groupBy("digest").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n"))
    with _settings(spark, STATE_CONF):
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()
        if not _committed(spark, log):
            return state_table(spark, schema[id_].dataType.simpleString())
        found = spark.read.format("statestore").load(log).select("key.digest", F.col("value.max").alias("at"), F.col("value.count").alias("n"))
        return cut_lineage(found, "digests")


def state_table(spark: SparkSession, id_type: str = "long") -> DataFrame:
    """A state without rows."""
    return spark.createDataFrame([], f"digest string, at struct<id:{id_type},file:string,row:long>, n long")


def _clashes(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Digests of which not all rows have the same bytes: hits are compared in full, hot groups folded in tasks first."""
    left, right = spread_over(rows.select("digest", "content", "at"), "digest", state, "n", ["at.file", "at.row"])
    # the repeated digests grow with the input, so they are never broadcast
    hits = left.join(right.filter("n > 1").select("digest", "_salt").hint("merge"), ["digest", "_salt"])
    folded = hits.groupBy("digest", "_salt").agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
    return folded.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("digest")


def exact_dedup(spark: SparkSession, path: str, log: str | None = None, id_: str = "doc_id", text: str = "text",
                digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """(id_, keep_id, group_size, kept, digest) of every row of the Parquet table at ``path``.

    Rows are equal when their texts have the same bytes; a null text counts as empty.
    Of equal rows the one with the greatest ``id_`` stays (``kept``), and ``keep_id`` is
    its id.  Rows of equal id and text are separate rows, of which the one found last by
    file and place stays; a null id is below every other.  Texts of one digest with different bytes are
    told apart by their bytes, whatever the digest.  Extra columns are not read, an empty
    table gives no rows, and lengths are not limited.  ``log`` names the folder of the state
    for later runs that take in more files; without it a fresh one is used.
    """
    state = take_in(spark, path, log or scratch_path(spark, "intake"), id_, text, digest, files_per_batch)
    rows = _rows(spark.read.schema(_schema(spark, path, id_, text)).parquet(path), id_, text, digest)
    left, right = spread_over(rows.select("digest", "at"), "digest", state, "n", ["at.file", "at.row"])
    told = left.join(right.select("digest", "_salt", F.col("at").alias("best"), "n").hint("merge"), ["digest", "_salt"]).drop("_salt")
    clashes = cut_lineage(_clashes(rows, state), "clashes")
    if clashes.limit(1).count():
        mixed = rows.join(clashes, "digest")
        groups = mixed.groupBy("digest", "content").agg(F.max("at").alias("best"), F.count(F.lit(1)).alias("n"))
        apart = mixed.join(groups, ["digest", "content"]).select(*told.columns)
        told = told.join(clashes, "digest", "left_anti").unionByName(apart)
    kept = (F.col("at.file") == F.col("best.file")) & (F.col("at.row") == F.col("best.row"))
    return told.select(F.col("at.id").alias(id_), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest")
