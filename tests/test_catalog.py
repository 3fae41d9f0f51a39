"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from orrery.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(pdf, columns):
    return sorted(str(tuple(None if v != v else v for v in r)) for r in pdf[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_sample_is_repeatable(spark):
    a, b = (sorted(map(tuple, catalog.queries()["sample_edges"](spark, SF).collect())) for _ in range(2))
    assert a == b and len(a) == 30


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
