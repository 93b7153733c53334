"""The registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def sorted_rows(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(__spark_entry__.ORACLE_SQL))
def test_matches_sql(spark, small, db, name):
    df = __spark_entry__.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    relation = db.sql(__spark_entry__.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    want = sorted_rows([tuple(r[i] for i in places) for r in relation.fetchall()])
    assert sorted_rows([tuple(r[c] for c in columns) for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.QUERIES) - set(__spark_entry__.ORACLE_SQL)))
def test_runs(spark, small, name):
    assert __spark_entry__.QUERIES[name](spark, small).count() > 0


def test_references_without_a_semicolon_are_those_of_the_sql(spark, tmp_path):
    pages = [(1, "<title>und&amp</title> a &amp; b &lt;i&gt;"), (2, "x&amp y &am z &copy 1 &copy; 2"), (3, "&quot;q&quot;&amp"), (4, "")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = c.sql(f"select page_id, cleaned from ({__spark_entry__.ORACLE_SQL['clean_text_pages']})").fetchall()
    got = __spark_entry__.QUERIES["clean_text_pages"](spark, str(tmp_path)).select("page_id", "cleaned").collect()
    assert sorted_rows(got) == sorted_rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
