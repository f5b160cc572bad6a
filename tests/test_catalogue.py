"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from residua.plans import catalogue

DIR = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if v is None or v is pd.NA or v != v else (round(float(v), 5) if isinstance(v, float) or "decimal" in type(v).__name__.lower() else str(v)) for v in r) for r in df.itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r)), list(df.columns)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    a, b = catalogue.QUERIES[name](spark, DIR).toPandas(), con.execute(catalogue.SQL[name]).df()
    (x, cols), (y, names) = rows(a), rows(b)
    assert cols == names and len(x) == len(y)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(key, x)) == sorted(map(key, y))
