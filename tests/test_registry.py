import glob
import math
import os

import duckdb
import pytest

from quillspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def comparable(rows):
    return sorted(([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:19] if v is not None else None for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = comparable([[r[c] for c in columns] for r in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows or "fuzzy_contains" in name
        return
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = comparable([[r[names.index(c)] for c in columns] for r in got.fetchall()])
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-5) for x, y in zip(a, b)), (a, b)


def test_flagship(spark):
    assert 0 < registry.flagship(spark, SF).count() <= 10
