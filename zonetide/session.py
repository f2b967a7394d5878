"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession

# Settings the operators rely on.  All of them are session-level and can be
# overridden by the cluster; none is needed for correctness except the zone.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "zonetide", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="zonetide-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, readable by every executor.

    A machine-local folder is made up only for a local master, where driver and
    executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_folder()
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/zonetide-{name}-{uuid.uuid4().hex}"


def cut_lineage(df, name: str = "cut"):
    """Write ``df`` once to the shared folder and read it back.

    Unlike a local checkpoint the table survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are written to the shared folder, as by :func:`cut_lineage`, and emptied when no longer needed.

    The shuffles of a write are removed at its end, so that of many steps only what one
    of them shuffles is on disk at a time.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def write(self, df, name: str):
        path, before = scratch_path(self.spark, name), self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(self.CLEANUP)
            else:
                self.spark.conf.set(self.CLEANUP, before)
        self.held.append((path, df.schema))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Empty the tables written so far; nothing may read them any more."""
        for path, schema in self.held:
            self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)
        self.held = []


def spread_by(df, *keys: str):
    """Rows dealt by their keys over all shuffle partitions: few rows that each become many would else stay in a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
