"""Event files become visible together or not at all; many small files are few tasks."""

import pytest
from pyspark.sql import functions as F

from canopy.sources import event_files as ef

DOC = "domain string, event_id string, part int, body string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(4)


def held(spark, path):
    return sorted((r["domain"] or "-", r["event_id"], r["kind"], r["part"], r["body"]) for r in ef.read_documents(spark, path).collect())


def test_runs_failures_and_resume(spark, tmp_path):
    path = str(tmp_path / "events")
    assert held(spark, path) == [] and ef.complete_events(spark, path).count() == 0
    full = [("a", "e/1", 0, '{"x": 1}'), ("a", "e/1", 1, "é"), (None, "e2", 0, ""), ("b c", "e3-7", 0, None)]
    ef.write_documents(frame(spark, full), frame(spark, [("a", "e/1", 0, "s1"), (None, "e2", 0, "s2")]), path)
    first = [("-", "e2", "full", 0, ""), ("-", "e2", "summary", 0, "s2"), ("a", "e/1", "full", 0, '{"x": 1}'), ("a", "e/1", "full", 1, "é"),
             ("a", "e/1", "summary", 0, "s1"), ("b c", "e3-7", "full", 0, "")]
    assert held(spark, path) == first
    assert sorted((r["domain"] or "-", r["event_id"]) for r in ef.complete_events(spark, path).collect()) == [("-", "e2"), ("a", "e/1")]
    # A task fails: the other tasks' documents do not show, and their files go.
    bad = frame(spark, [("a", f"n{i}", 0, "new") for i in range(40)]).withColumn("event_id", F.when(F.col("event_id") != "n33", F.col("event_id")))
    with pytest.raises(Exception, match="event file needs"):
        ef.write_documents(bad, frame(spark, [("a", "n1", 0, "new")]), path)
    assert held(spark, path) == first
    assert len(list((tmp_path / "events" / "data").iterdir())) == 1
    # A later run replaces an event whole.
    ef.write_documents(frame(spark, [("a", "e/1", 0, "again")]), frame(spark, [("a", "e/1", 0, "s")]), path)
    assert held(spark, path) == [*first[:2], ("a", "e/1", "full", 0, "again"), ("a", "e/1", "summary", 0, "s"), first[5]]


def test_many_small_files_are_few_tasks(spark, tmp_path):
    path = str(tmp_path / "events")
    docs = spark.range(5000).select(F.lit("d").alias("domain"), F.col("id").cast("string").alias("event_id"), F.to_json(F.struct("id")).alias("body")).repartition(8)
    ef.write_documents(docs, docs, path)
    rows = spark.read.format(ef.FORMAT).option("path", path).load()
    assert 10 <= rows.rdd.getNumPartitions() <= 30
    assert rows.groupBy("kind").agg(F.countDistinct("event_id").alias("n"), F.count("*").alias("m")).collect()[0][1:] == (5000, 5000)
