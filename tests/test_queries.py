import duckdb
import pytest

import __spark_entry__ as entry
from lexspan.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    result = duck.execute(plans.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(repr(tuple(dict(zip(names, r))[c] for c in order)) for r in result.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == want


def test_numbers_of_odd_texts_equal_sql(spark, duck, tmp_path):
    texts = ["call (030)1234, 5%7 and %20%21", "id 12345678901234567890, 1234567890123456.785", "1" + "0" * 400, "(12)(13) $5$6 5)) 7", "100 0.00 1,000.50", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sql = plans.SQL["numbers_of_texts"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, plans.QUERIES["numbers_of_texts"](spark, str(tmp_path)).collect())) == sorted(duck.execute(sql).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_run(spark):
    for name in set(plans.QUERIES) - set(plans.SQL):
        assert plans.QUERIES[name](spark, SF).count() > 0
