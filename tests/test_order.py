"""Orders of whole tables: rows in order, none left out."""

import duckdb
import pytest

from marlpit.plans import catalogue


@pytest.mark.parametrize("name,table", [("order_nulls_all", "lineitem"), ("order_collate_nocase_all", "part")])
def test_whole_table_in_order(spark, sf_dir, name, table):
    duck = duckdb.connect()
    duck.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    df = catalogue.QUERIES[name](spark, sf_dir)
    wanted = duck.sql(catalogue.ORACLES[name])
    assert df.columns == wanted.columns
    found = [tuple(r) for r in df.collect()]
    assert found == wanted.fetchall()
    assert len(found) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
