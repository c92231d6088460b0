"""Every query with SQL gives what DuckDB gives on the same files."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("PARITY_DATA", "/root/testdata/sf0.001")
if not os.path.isdir(DATA):
    pytest.skip("no test tables here", allow_module_level=True)

from heronry.plans.catalogue import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return c


def canon(rows):
    def one(v):
        if isinstance(v, float):
            return repr(round(v, 6))
        if isinstance(v, (list, tuple)):
            return str([one(x) for x in v])
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, DATA).count()
