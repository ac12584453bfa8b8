"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from gaugeworks.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, decimal.Decimal, float)) and not (isinstance(v, float) and math.isnan(v)):
        return round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = db.sql(SQL[name])
    assert sorted(want.columns) == cols
    rows = lambda data: sorted((tuple(map(plain, r)) for r in data), key=str)
    assert rows(got.select(*cols).collect()) == rows(want.select(",".join(f'"{c}"' for c in cols)).fetchall())
