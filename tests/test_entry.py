"""The driver contract, and plans that must keep their shape at scale."""

import re

import __spark_entry__ as entry
from rowtide.operators import fold
from rowtide.plans import feed
from rowtide.plans.queries import QUERIES


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_combines_before_its_only_shuffle(spark, sf):
    text = plan(fold.fold_latest(feed.changes(spark, sf)))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_max_by" in text and "Window" not in text


def test_scans_read_only_what_they_need(spark, sf):
    text = plan(QUERIES["live_rows_per_table"](spark, sf))
    assert re.search(r"ReadSchema: struct<event_id:bigint,[^>]*>", text)
    counters = plan(QUERIES["pipeline_metrics"](spark, sf))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in counters
    page = plan(QUERIES["keyset_page_single"](spark, sf))
    assert "TakeOrderedAndProject" in page and "GreaterThan(o_orderkey,321)" in page


def test_commits_shuffle_no_images(spark, sf):
    for name in ("commits", "connector_checkpoint"):
        execution = QUERIES[name](spark, sf)._jdf.queryExecution()
        text = spark._jvm.PythonSQLUtils.explainString(execution, "formatted")
        shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", text)
        assert shuffled and not any(re.search(r"\brows#", columns) for columns in shuffled), name


def test_no_cartesian_products_and_no_python_in_plans(spark, sf):
    for name in ("latest_state_meta", "commit_groups", "schema_state", "connector_status", "rebuild_outcomes"):
        text = plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "Python" not in text, name
