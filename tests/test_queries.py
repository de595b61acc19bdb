"""Every query of the reference operations against its SQL over the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from tesserae.queries import QUERIES, SQL  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.6g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    out = QUERIES[name](spark, FOLDER)
    columns = sorted(out.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in out.collect())
    if name not in SQL:
        assert got
        return
    found = tables.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.startswith("scalar_") and "customer" in SQL[n]])
def test_scalars_of_customers_whose_divisor_is_0(spark, tmp_path, name):
    rows = [(k, f"Customer#{k:09}", float(n), "BUILDING") for k, n in enumerate([-21, -21, 0, 21, -21.01, 7])]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.id: r.x for r in QUERIES[name](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = dict(c.execute(f"SELECT id, x FROM ({SQL[name]})").fetchall())
    assert {k: plain(x) for k, x in got.items()} == {k: plain(x) for k, x in want.items()}
    assert name != "scalar_divide" or got[1] == -math.inf
