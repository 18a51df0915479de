import duckdb
import pytest

from cairn.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = registry.queries()[name](spark, SF)
    con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*names).collect())) == sorted(con.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_covers_its_table(spark, name):
    table = "pages" if name.startswith("op8") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    found = registry.queries()[name](spark, SF).select(key).distinct().count()
    assert found == spark.read.parquet(f"{SF}/{table}.parquet").count()
