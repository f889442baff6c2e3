import os

import duckdb
import pytest

from corvath.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    own = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    rel = tables.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert own == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_other_queries_run(spark, name):
    catalogue.QUERIES[name](spark, SF).limit(5).collect()


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["markdown_sections"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(mime_type,text/markdown)" in plan and "ReadSchema: struct<doc_id:bigint,text:string,mime_type:string>" in plan
