import duckdb
import pytest

from logquarry.plans.registry import QUERIES, SQL
from tests.oracle import rows_of_df, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert rows_of_df(QUERIES[name](spark, SF)) == rows_of_sql(SQL[name], SF)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["log_secret_lines", "log_mask_secrets"])
def test_secrets_of_texts_in_upper_case_are_as_in_the_sql(spark, tmp_path, name):
    token = 'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"'
    rows = [(1, f"a {token} b\n{token}"), (2, f"a {token} b".upper()), (3, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(SQL[name]).fetchall())
