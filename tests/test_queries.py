"""Every registered query with SQL gives DuckDB's rows; the others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from verdimill.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda x: round(x, 7) if isinstance(x, float) and math.isfinite(x) else x
    return sorted(repr([fix(r[i]) for i in order]) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLE:
        want = con.execute(ORACLE[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, want.fetchall())
    else:
        assert got


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_empty_tables(spark, tmp_path, sf):
    for p in glob.glob(f"{sf}/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(str(tmp_path / os.path.basename(p)))
    for name in ("flag_top_n", "verdict_counts", "combine_parts", "rerank", "rank_budget_prefix", "pairwise_sort", "gate_compose", "calibrate_sweep", "auc_by_lang", "cache_to_ask", "error_streaks", "heads_selected_branch", "funnel_two_stage"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_plans_prune_columns_and_push_filters(spark, sf):
    plan = QUERIES["flag_top_n"](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
