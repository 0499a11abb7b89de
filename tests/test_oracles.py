"""Every query of the library with SQL against DuckDB on the small tables."""

import duckdb
import pandas as pd
import pytest

from wardstream import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return c


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def text(x):
        if x is None or x is pd.NaT or (not isinstance(x, (list, dict)) and pd.isna(x) is True):
            return "null"
        if isinstance(x, (float, int)) and not isinstance(x, bool):
            return repr(round(float(x), 6) + 0.0)
        return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x)

    return sorted(tuple(map(text, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = Q.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["user_id", "obs", "n", "hr", "temp", "lactate", "hr_slope", "risk_level"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
