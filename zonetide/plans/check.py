"""Run registered queries against their SQL and print the differences.

    python -m zonetide.plans.check [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

from zonetide.plans.catalog import REGISTRY, run
from zonetide.session import local_session

# Column types that must agree exactly.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str(list(v))
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False))


def compare(name: str, df: DataFrame, con) -> tuple[str, str]:
    """Status and note of one query's result against its SQL."""
    got = df.toPandas()
    sql = REGISTRY[name][1]
    if sql is None:
        return "rows", f"{len(got)} rows"
    con.execute(f"CREATE OR REPLACE TEMP VIEW checked AS {sql}")  # the SQL has to be storable
    result = con.sql("SELECT * FROM checked")
    kinds = dict(zip(result.columns, map(str, result.types), strict=True))
    mine = {c: TYPES.get(t, t) for c, t in df.dtypes}
    if kinds != mine:
        return "FAIL", f"schema {sorted(set(mine.items()) ^ set(kinds.items()))}"
    want = result.df()
    if len(got) != len(want):
        return "FAIL", f"rows {len(got)} / {len(want)}"
    if not len(got):
        return "FAIL", "no rows"
    # integers that meet nulls become floats on one side only
    for c, t in mine.items():
        if t in ("BIGINT", "INTEGER") and (got[c].isna().any() or want[c].isna().any()):
            got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
    a, b = canonical(got), canonical(want)
    if a == b:
        return "ok", f"{len(got)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return "FAIL", f"{len(bad)} of {len(a)} differ; columns {sorted(got.columns)}; e.g. {bad[0]}"


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    prefixes = argv[2:]
    spark, con, failed = local_session("check"), duck(sf_dir), 0
    for name in REGISTRY:
        if prefixes and not any(name == p or name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            status, note = compare(name, run(name, spark, sf_dir), con)
        except Exception as error:  # noqa: BLE001 - report and go on
            status, note = "ERROR", str(error).split("\n")[0][:600]
            if len(prefixes) == 1:
                traceback.print_exc()
        failed += status in ("FAIL", "ERROR")
        print(f"{status:5} {name:34} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
