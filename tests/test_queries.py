"""Every query of the core against its SQL, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from arpent.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else round(float(v), 6)
    return str(v)[:10] if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, sf_dir, db, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE:
        assert got
        return
    found = db.execute(catalog.ORACLE[name])
    order = [x[0] for x in found.description]
    assert sorted(order) == names
    want = sorted((tuple(plain(r[order.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert got == want
