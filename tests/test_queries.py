"""Every named query against its SQL counterpart, and the shape of its plan."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import catalog, catalog_sql

QUERIES, SQL = catalog.QUERIES, catalog_sql.SQL
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want


def test_all_are_registered():
    assert QUERIES.items() <= entry.queries().items() and SQL.items() <= entry.oracle_sql().items()


def test_flagship(spark):
    assert entry.entry(spark).count() == 4


def scan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = scan(QUERIES["type_counts"](spark, sf_dir))
    assert "ReadSchema: struct<" in plan and "text" not in plan.split("ReadSchema:")[1].split("\n")[0]
    plan = scan(QUERIES["drop_null_keys"](spark, sf_dir))
    assert "PushedFilters: [" in plan


def test_cleaning_is_one_narrow_stage(spark, sf_dir):
    from palimpsest.plans.cleaning import clean_items
    from palimpsest.sources.tables import load_table

    docs = load_table(spark, sf_dir, "documents").withColumnRenamed("text", "transcript")
    assert "Exchange" not in scan(clean_items(docs, date=None))


def test_summary_aggregates_before_its_only_shuffle(spark, sf_dir):
    from palimpsest.operators import profile
    from palimpsest.sources.tables import load_table

    plan = scan(profile.messy_summary(profile.messy_columns(load_table(spark, sf_dir, "documents"), "text"), ["lang"]))
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_mean_scores_holds_every_metric(spark, sf_dir, duck):
    from palimpsest.operators import evaluate

    want = {(f"response_{i}", m) for i in (1, 2, 3) for m in evaluate.METRICS}
    wide = {r.model: r for r in QUERIES["mean_scores_wide"](spark, sf_dir).collect()}
    got = {(r.model, r.metric): r.score for r in QUERIES["mean_scores"](spark, sf_dir).collect()}
    assert set(got) == want == {tuple(r) for r in duck.execute(f"SELECT model, metric FROM ({SQL['mean_scores']})").fetchall()}
    assert all(score == wide[model][metric] for (model, metric), score in got.items())
