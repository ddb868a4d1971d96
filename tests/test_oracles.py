"""Every registered query outside the llm subpackage against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def _rows(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rel = duck.execute(registry.ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(got.columns)
    assert _rows(tuple(r) for r in got.select(*cols).collect()) == _rows(rel.fetchall())
