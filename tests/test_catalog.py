"""Every query against its SQL."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

from weftgraph.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{D}/{name}.parquet'")
    return db


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return x.isoformat() if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, D)
    names = sorted(got.columns)
    found = db.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = Counter(tuple(plain(row[columns.index(c)]) for c in names) for row in found.fetchall())
    assert Counter(tuple(plain(r[c]) for c in names) for r in got.collect()) == want
    assert want or name == "g_isolated"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0
