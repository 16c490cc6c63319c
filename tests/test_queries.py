"""Every registered query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from inspectra import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: These find nothing at the smallest size; the larger sizes of the driver's check do.
MAY_BE_EMPTY = {"near_duplicates", "near_leakage", "exact_leakage", "split_hash_leakage"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    done = duck.execute(plans.ORACLES[name])
    want = rows([d[0] for d in done.description], done.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] or name in MAY_BE_EMPTY
    for a, b in zip(*(x[1] for x in (got, want))):
        assert all(x == y or isinstance(x, float) and x == pytest.approx(y, abs=2e-5) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "final_status" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
