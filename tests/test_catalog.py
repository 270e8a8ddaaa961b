"""Every query of the library beside its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillon import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def canonical(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return str(value).lower() if isinstance(value, bool) else repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_its_sql(name, spark, small, duck):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(map(canonical, r)) for r in df.select(*columns).collect())
    if name not in catalog.SQL:
        assert got
        return
    sql = catalog.SQL[name].strip().rstrip(";")
    listed = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tuple(map(canonical, r)) for r in duck.sql(f"select {listed} from ({sql})").fetchall())
    assert sorted(duck.sql(sql).columns) == columns
    assert got == want


@pytest.mark.parametrize("name", [n for n in catalog.EXAMPLES if n not in catalog.INLINE])
def test_worked_examples(name, spark, small, duck):
    """Those whose queries run over tables; the others are among the queries."""
    df = catalog.EXAMPLES[name](spark, small)
    columns = sorted(df.columns)
    want = duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({catalog.EXAMPLE_SQL[name]})").fetchall()
    assert sorted(tuple(map(canonical, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(canonical, r)) for r in want)


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES and catalog.FLAGSHIP in catalog.SQL
