"""Every registered query of the mixture engine against its SQL in DuckDB."""

import duckdb
import pytest

from factorlake import plans

SF = "/root/testdata/sf0.001"


def same(a, b):
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
    return sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_oracle(spark, duck, name):
    assert same(plans.queries()[name](spark, SF).toPandas(), duck.execute(plans.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry_names():
    import __spark_entry__ as entry

    assert set(plans.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
