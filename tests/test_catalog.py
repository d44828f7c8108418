import duckdb
import pandas as pd
import pytest

import __spark_entry__
from stacklight.plans import catalog, catalog_runs  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(df):
    text = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(str(tuple(map(text, row))) for row in df[sorted(df.columns)].astype(object).values.tolist()) if len(df) else []


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), con.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


@pytest.mark.parametrize("name", ["plan_destinations", "collision_rename"])
def test_plans_of_large_ids_equal_sql(spark, sf_dir, name, tmp_path):
    """Ids whose days lie beyond nanoseconds in a bigint, beyond four digits of a year, and before the epoch."""
    con = duckdb.connect()
    con.execute(f"create table documents as select * replace (doc_id + shift as doc_id) from '{sf_dir}/documents.parquet', (select unnest([0, 88000, 650000, 2900000, 100000000, -750000, -100000]) as shift)")
    con.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(catalog.SQL[name]).df()
    assert shown(got) == shown(want)


def test_renames_of_repeated_ids_equal_sql(spark, sf_dir, tmp_path):
    con = duckdb.connect()
    con.execute(f"create table documents as select * from '{sf_dir}/documents.parquet' union all select * replace (text || '!' as text, 'other' as source) from '{sf_dir}/documents.parquet' where doc_id % 2 = 0")
    con.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    got, want = catalog.QUERIES["collision_rename"](spark, str(tmp_path)).toPandas(), con.sql(catalog.SQL["collision_rename"]).df()
    assert shown(got) == shown(want)


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
