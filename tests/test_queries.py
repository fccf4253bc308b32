import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check_queries import compare, oracle

from canopy.functions import noise
from canopy.sources import sinks

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# One of each family here; tools/check_queries.py runs all of them.
CHECKED = ["k1_top_keywords", "f1_light_noise", "f2_strict_noise", "f3_quality_split", "g3_threads", "w9_packed_requests", "a9_thread_stats",
           "a13_a15_domain_totals", "j7_nested_parents", "k13_matches", "l5_row_split", "a19_class_report", "j4_serving_events", "a25_script_audit",
           "s1_read_posts", "st2_user_sessions", "st6_volumes"]
NATIVE = ["k1_top_keywords", "f1_light_noise", "g8_graph_nodes", "a9_thread_stats", "j7_nested_parents", "k3_popular_comments", "a22_tfidf", "w1_renumber"]


@pytest.mark.parametrize("name", CHECKED)
def test_agrees_with_sql(spark, name):
    state, detail, _ = compare(spark, oracle(SF), SF, name, QUERIES[name], SQL[name])
    assert state == "ok", detail


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", NATIVE)
def test_core_jobs_stay_in_the_engine(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan


def test_top_rows_are_cut_before_the_shuffle(spark):
    plan = QUERIES["k3_popular_comments"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_run_metrics_count_noise(spark):
    state, detail, _ = compare(spark, oracle(SF), SF, "s13_run_metrics", QUERIES["s13_run_metrics"], SQL["s13_run_metrics"])
    assert state == "ok", detail
    got = QUERIES["s13_run_metrics"](spark, SF).first()
    assert got["n_raw"] == got["n_trash"] + got["n_clean"]


def test_observed_counts_of_noise(spark, tmp_path):
    rows = spark.createDataFrame([("a whole sentence of words",), ("12345",), ("!!!",), (None,), ("another sentence here",)], "text string")
    df, seen = sinks.observed(rows, noise.is_light_noise(F.col("text")))
    df.write.parquet(str(tmp_path / "x"))
    assert seen.get == {"n_raw": 5, "n_trash": 3, "n_clean": 2}
