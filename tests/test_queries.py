"""Every query of the core that has SQL gives the rows of that SQL; the others run."""

import math
import os

import duckdb
import pytest

from recollect.plans.catalog import QUERIES, SQL

DATA = os.environ.get("RECOLLECT_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings personas sessions key_points queries event_nodes".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == columns
        assert rows == sorted((tuple(plain(v[names.index(c)]) for c in columns) for v in r.fetchall()), key=str)
