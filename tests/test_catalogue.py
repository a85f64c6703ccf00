import duckdb
import pytest

from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(tuple(None if x != x else x for x in r)) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, small, duck, name):
    got, want = catalogue.QUERIES[name](spark, small).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_without_sql(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0
