"""Each registered query of the library against its SQL on DuckDB."""

import duckdb
import pytest

import __spark_entry__
from notewell.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    want = duck.sql(catalogue.SQL[name])
    columns = want.columns
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(catalogue.SQL) <= set(__spark_entry__.oracle_sql())


def test_inbound_links_counts_links_after_the_tenth(spark, tmp_path):
    names = [f"note{i}" for i in range(13)]
    linked = "".join(f'<a href="/{n}">x</a>' for n in names[1:])
    pages = [(i, f"http://h/s/{n}", f"<title>{n} t</title>" + linked * (i == 0)) for i, n in enumerate(names)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.id: r.inbound for r in catalogue.QUERIES["inbound_links"](spark, str(tmp_path)).collect()}
    assert got == {0: 0} | {i: 1 for i in range(1, 13)}
    assert catalogue.QUERIES["extract_links"](spark, str(tmp_path)).count() == 10
