"""Every registered query of the library's own operators against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sondera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(tuple(str(round(x, 5) + 0.0) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    cols = sorted(want.columns)
    assert cols == sorted(df.columns)
    order = [want.columns.index(c) for c in cols]
    assert normal([[r[c] for c in cols] for r in df.collect()]) == normal([[r[i] for i in order] for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"fus4_fit_head", "prb1_linear_probe"}))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
