import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from fathom.functions.frames import cut, release

DATA = "/root/testdata/sf0.001"
QUICK = ["latest_pages", "page_quality", "dense_pages", "cross_check", "series_check", "drift_rows", "surprisal", "ranking", "resolved_entities", "items_table", "alignment", "units", "drift", "sanity", "parsed_filings", "filing_check", "row_figures", "derived_totals", "context_items", "extracted_items", "better_reading"]


def test_names_and_sql_belong_together():
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries) and "drift" in queries and len(queries) > 30


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_rows_agree_with_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry_point.queries()[name](spark, DATA)
    names = sorted(df.columns)
    plain = lambda x: None if x is None or x != x else round(x, 9) if isinstance(x, float) else str(x)
    mine = sorted(([plain(x) for x in r] for r in df.select(*names).collect()), key=repr)
    rel = con.sql(entry_point.oracle_sql()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    assert mine == sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)


def test_cut_tables_are_released(spark):
    release(spark)
    df = cut(spark.range(5))
    assert df.count() == 5 and release(spark) == 1 and release(spark) == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0
