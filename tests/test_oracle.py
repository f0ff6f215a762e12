"""Every query that SQL can express gives the rows of its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from glotweave.plans.oracle import ORACLE
from glotweave.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    mine = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    assert mine == sorted(repr(tuple(plain(x[i]) if not hasattr(x[i], "is_nan") else float(x[i]) for i in at)) for x in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
