"""Every query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from folio.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer orders events documents labels pages".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame):
    plain = lambda x: None if x is None or x is pd.NA or x != x else int(x) if "int" in type(x).__name__ or isinstance(x, float) else str(x)
    return sorted(([plain(x) for x in r] for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
