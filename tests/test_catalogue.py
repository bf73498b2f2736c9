"""Every query with SQL gives the same rows as the SQL."""

import duckdb
import pytest

from granary.plans.catalogue import ORACLES, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return str(round(v, 9))
    return bytes(v).hex() if isinstance(v, bytes | bytearray) else str(v)


def rows(found, columns, names):
    at = [names.index(c) for c in columns]
    return sorted(tuple(plain(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows([tuple(r) for r in df.collect()], columns, df.columns)
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == rows(found.fetchall(), columns, names)
    else:
        assert got


def test_fixed_plans_push_down(spark):
    """Two columns are asked for, and two are read."""
    plan = QUERIES["file_level_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
