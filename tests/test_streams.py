"""Trailing counts on a stream: many batches, late rows, and a restart."""

from collections import Counter
from datetime import datetime, timedelta

import pytest

from zonetide.streaming import flows

T0 = datetime(2024, 1, 1)
SCHEMA = "zone string, ts timestamp"


def _put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _brute(rows, widths, seen):
    """Rows out once the day is two days before the latest event seen."""
    days = Counter((z, (t - T0).days) for z, t in rows)
    done = (seen - timedelta(days=2) - T0).days
    out = {}
    for until in range(1, done + 1):
        for zone in {z for z, _ in days}:
            n = tuple(sum(c for (z, d), c in days.items() if z == zone and until - k <= d < until) for k in widths)
            if n[-1]:
                out[(T0 + timedelta(days=until)).date(), zone] = n
    return out


def _read(df, widths):
    rows = [((r.until, r.zone), tuple(r[f"n{k}"] for k in widths)) for r in df.collect()]
    assert len(rows) == len(dict(rows))  # every row comes out once
    return dict(rows)


@pytest.fixture
def at(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return lambda days, hour=5: T0 + timedelta(days=days, hours=hour)


def test_batches_and_restart_equal_one_run(spark, tmp_path, at):
    folder, sink, widths = str(tmp_path / "in"), str(tmp_path / "out"), (2, 5)
    first = [("a", at(0)), ("a", at(0, 7)), ("b", at(1)), ("a", at(3))]
    second = [("b", at(6)), ("a", at(9)), ("a", at(9, 8))]
    third = [("c", at(14)), ("b", at(20))]
    _put(spark, folder, first)

    def run():
        stream = flows.event_stream(spark, folder, spark.read.parquet(folder).schema, "*.parquet", "ts", files_per_trigger=1)
        return flows.run_to_table(flows.trailing_counts(stream, "ts", ["zone"], widths), "x", sink=sink)

    assert _read(run(), widths) == _brute(first, widths, at(3))
    _put(spark, folder, second)
    _put(spark, folder, third)
    got = _read(run(), widths)
    assert got == _brute(first + second + third, widths, at(20))
    assert ((T0 + timedelta(days=15)).date(), "a") not in got  # its last day has left the longest width
    assert _read(run(), widths) == got  # nothing new, nothing twice


def test_late_rows(spark, tmp_path, at):
    folder, sink, widths = str(tmp_path / "in"), str(tmp_path / "out"), (3,)
    _put(spark, folder, [("a", at(0)), ("a", at(10))])

    def run():
        stream = flows.event_stream(spark, folder, spark.read.parquet(folder).schema, "*.parquet", "ts")
        return flows.run_to_table(flows.trailing_counts(stream, "ts", ["zone"], widths), "x", sink=sink)

    run()
    late, in_time = ("a", at(2)), ("a", at(9))
    _put(spark, folder, [late, in_time, ("a", at(16))])
    assert _read(run(), widths) == _brute([("a", at(0)), ("a", at(10)), in_time, ("a", at(16))], widths, at(16))
