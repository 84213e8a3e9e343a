"""Every query of the library with its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from corpuslens.plans import queries as own

DATA = Path("/root/testdata/sf0.001")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", own.oracle_sql())
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    expected, found = db.sql(own.oracle_sql()[name]).df(), own.queries()[name](spark, str(DATA)).toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_dispositions_partition_the_input(spark):
    found = own.clean_pipeline(spark, str(DATA)).toPandas()
    assert found["n"].sum() == own.articles(spark, str(DATA)).filter("is_active").count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
