"""Every query of the catalogue against its SQL on the smallest tables."""

import duckdb
import pytest

from marginflow.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings", "orders", "lineitem", "part", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(columns, data):
    key = lambda r: tuple((x is None, str(type(x) is bool), x if x == x else float("inf")) for x in r)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(r[i] for i in order) for r in data], key=key)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    assert got or name == "inversion_rate"  # too few traces here
    if name not in catalog.ORACLES:
        return
    rel = duck.execute(catalog.ORACLES[name])
    a, b = rows(df.columns, got), rows([d[0] for d in rel.description], rel.fetchall())
    assert a[0] == b[0] and len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1]):
        assert all(p == q or (p != p and q != q) for p, q in zip(x, y)), (x, y)
