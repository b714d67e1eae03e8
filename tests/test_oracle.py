"""Every imaging query against its SQL on DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from framelake.plans import catalogue, stores  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        return v
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    result = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(got.columns) == sorted(columns)
    left, right = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(columns, want)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5 * max(1, abs(x))) or (isinstance(y, float) and abs(float(x) - y) <= 2e-5) for x, y in zip(a, b)), (a, b)
