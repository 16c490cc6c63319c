"""Every training-data query that SQL can express against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from inspectra.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet/*'" if os.path.isdir(f"{SF}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    done = duck.execute(queries.ORACLES[name])
    want = rows([d[0] for d in done.description], done.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1]) > 0
    for a, b in zip(got[1], want[1]):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6) for x, y in zip(a, b)), (a, b)
