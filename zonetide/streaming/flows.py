"""Streaming intake, windowed counts, deduplication and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonetide.operators.spatial import points_in_polygons
from zonetide.session import scratch_path


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str, time: str, files_per_trigger: int | None = None) -> DataFrame:
    """File source with the event time as a UTC timestamp (watermarks need it)."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn(time, F.col(time).cast("timestamp"))


def split_valid(stream: DataFrame, required: Sequence[str]) -> DataFrame:
    """Mark rows whose required fields are all present and not blank."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return stream.withColumn("accepted", ok)


def run_to_table(stream: DataFrame, name: str, partition_by: Sequence[str] = (), mode: str = "append", sink: str | None = None) -> DataFrame:
    """Drain what is available into Parquet and read it back.

    Sink and progress log live in the shared folder.  A run with the same ``sink``
    goes on after what earlier runs took in; without one a fresh path is used.
    """
    spark = stream.sparkSession
    sink = sink or scratch_path(spark, name)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", sink + "-log").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start(sink)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def tumbling_counts(stream: DataFrame, time: str, keys: Sequence[str], delay: str = "2 days", width: str = "1 day") -> DataFrame:
    """Counts per key and closed window; rows later than ``delay`` are dropped."""
    return (
        stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").cast("date").alias("date"), *keys, "n")
    )


def sliding_counts(stream: DataFrame, time: str, keys: Sequence[str], width: str, slide: str, delay: str = "2 days") -> DataFrame:
    return (
        stream.withWatermark(time, delay).groupBy(F.window(time, width, slide), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.end").cast("date").alias("until"), *keys, "n")
    )


def trailing_counts(stream: DataFrame, time: str, keys: Sequence[str], widths: Sequence[int], delay: str = "2 days") -> DataFrame:
    """Counts of the last ``widths`` days per key at the end of every day, as the stream goes.

    The first state holds one count per key and open day; closed days go on to a second
    state that holds, per key and day to come, the days that still count for it.  Both
    expire with the watermark: a day's row comes out once it is ``delay`` past, later
    rows are dropped, and a key comes out as long as a day of it counts.
    """
    days = (
        stream.withWatermark(time, delay).groupBy(F.window(time, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n"))
        .select(F.window_time("window").alias("_at"), F.col("window.start").cast("date").alias("_day"), *keys, "n")
    )
    held = days.groupBy(F.window("_at", f"{max(widths)} days", "1 day"), *keys).agg(F.collect_list(F.struct("_day", "n")).alias("_days"))
    until = F.col("window.end").cast("date")

    def last(k: int) -> Column:
        inside = F.filter("_days", lambda d: d["_day"] >= F.date_sub(until, k))
        return F.aggregate(inside, F.lit(0).cast("long"), lambda s, d: s + d["n"]).alias(f"n{k}")

    return held.select(until.alias("until"), *keys, *(last(k) for k in widths))


def drop_repeats(stream: DataFrame, key: Sequence[str], time: str, delay: str = "2 days") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def place(stream: DataFrame, polygons: DataFrame, poly_id: str, ring: str, x: str, y: str, size: float | None = None, holes: str | None = None) -> DataFrame:
    """Points of a stream with the polygon around them, or null; polygons are static."""
    return points_in_polygons(stream, polygons, poly_id, ring, x, y, size, how="left", holes=holes)


def enrich(stream: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Stream-static left join; the static side is read anew per micro-batch."""
    return stream.join(dim, key, "left")
