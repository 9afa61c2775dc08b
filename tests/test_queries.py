"""Registered queries: structure of all, values of a sample of them against DuckDB."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foretrace.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["items_resolved", "eligible_first_stays", "chart_events_in_window", "cohort_splits", "gaps_interpolated",
          "nearest_embeddings", "forecast_naive", "signed_rank_on_prices", "rank_sum_test", "answer_forecasts"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for q in QUERIES.values():
        names = [n for n, _ in q.columns]
        assert len(names) == len(set(names)) and {t for _, t in q.columns} <= set("idsb")


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["variable", "smape", "mae", "rmse", "n_obs"] and df.count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in res.description]
    key = lambda r: [(v is None, str(v)) for v in r]
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    theirs = sorted(res.fetchall(), key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=1e-5))


@pytest.mark.parametrize("name", ["observation_summary", "chart_events_in_window"])
def test_scans_read_only_what_they_need(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_item_list_reaches_the_scan(spark, tmp_path):
    from datetime import datetime

    from foretrace.operators import cohort, items

    path = str(tmp_path / "chart")
    spark.createDataFrame([(1, 7, datetime(2150, 1, 1), 1.0), (1, 8, datetime(2150, 1, 1), 1.0)],
                          "stay_id long, itemid long, charttime timestamp, valuenum double").withColumn(
        "unused", F.lit("x")).write.parquet(path)
    stays = spark.createDataFrame([(1, datetime(2150, 1, 1))], "stay_id long, intime timestamp")
    wanted = spark.createDataFrame([(7,)], "itemid long")
    assert items.pushable_ids(wanted, limit=0) is None
    out = cohort.extract_events(spark.read.parquet(path), wanted, stays, 48, item_ids=items.pushable_ids(wanted))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(valuenum)" in plan and "EqualTo(itemid,7)" in plan.replace("In(itemid, [7])", "EqualTo(itemid,7)")
    assert "unused" not in plan and out.count() == 1
