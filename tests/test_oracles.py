"""Every registered query against its DuckDB twin, on the smallest scale factor."""

import math
import os

import duckdb
import pytest

from marginalia.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    relation = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert got == rows(relation.columns, relation.fetchall())
