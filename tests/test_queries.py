"""Every registered query runs; those with SQL agree with DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"] + [n for n in SQL if n.startswith("op")]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    d = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted(tuple("None" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in d.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    pdf = pd.DataFrame([r.asDict() for r in got.collect()], columns=got.columns, dtype=object)
    if name not in SQL:
        assert got.columns
        return
    cur = con.execute(SQL[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    assert sorted(want.columns) == sorted(pdf.columns)
    assert rows(pdf) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
