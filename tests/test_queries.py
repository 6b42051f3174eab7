"""Every registered query of the library's own operators on sf0.001: against its SQL where it has one, else that it runs."""

import datetime
import os
from decimal import Decimal

import duckdb
import pytest

from lodestone.plans.catalog import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert len(got) > 0
        return
    rel = duck.execute(ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in place) for r in rel.fetchall())
    assert got == want
