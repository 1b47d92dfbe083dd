"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(set(entry.oracle_sql()) - {n for n in entry.queries() if n.startswith("op") and n[2:3].isdigit()} - {"pipeline"})


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    expected = sorted(repr([plain(r[i]) for i in at]) for r in relation.fetchall())
    assert found == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_others_run(spark):
    for name in ("page_links", "title_ratios", "fuzzy_search", "ann_topk"):
        assert entry.queries()[name](spark, SF).count() > 0
