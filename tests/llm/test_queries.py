"""Text queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__
from zonetide.llm.queries import ORACLE_SQL, QUERIES
from zonetide.plans.check import duck


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(name, spark, sf_dir):
    want = duck(sf_dir).sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r) for r in want.select(*got.columns).fetchall()] if hasattr(want, "select") else []
    plain = lambda rows: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain(map(tuple, got.collect())) == plain(rows)
