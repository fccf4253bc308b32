"""Domain insights over events with (or still without) an analysis.

events: id_content, domain, ten_su_kien, time_event, analysed, total, clean, trash (null without analysis).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.text import percent
from canopy.operators.ordering import top_rows


def emotion_event_counts(df: DataFrame) -> DataFrame:
    """clean and trash of an emotion summary: clean is the sum of the labels, trash what the total exceeds it by."""
    clean = F.aggregate(F.map_values("emotion_stats"), F.lit(0).cast("long"), lambda a, v: a + v)
    out = df.withColumn("clean", clean).withColumn("total", F.col("total_comments"))
    return out.withColumn("trash", F.greatest(F.col("total") - F.col("clean"), F.lit(0)))


def _sums() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return [F.count("*").alias("total_events"), F.count_if("analysed").alias("events_with_analysis"),
            F.count_if(~F.col("analysed")).alias("events_without_analysis"), total("total").alias("total_raw"),
            total("clean").alias("total_clean"), total("trash").alias("total_trash")]


def domain_totals(events: DataFrame) -> DataFrame:
    """One row per domain and one for all (domain null), from a single rollup."""
    out = events.rollup("domain").agg(*_sums())
    return out.withColumn("trash_rate", percent(F.col("total_trash"), F.col("total_raw")))


def events_by_year(events: DataFrame) -> DataFrame:
    year = F.substring(F.coalesce("time_event", F.lit("")), 1, 4)
    return events.groupBy("domain", F.when(year == "", "unknown").otherwise(year).alias("year")).agg(F.count("*").alias("n"))


def label_distribution(counts: DataFrame) -> DataFrame:
    """Label totals per domain with their share. counts: domain, label, n."""
    per = counts.groupBy("domain", "label").agg(F.sum("n").alias("count"))
    whole = per.groupBy("domain").agg(F.sum("count").alias("_all"))
    return per.join(whole, "domain").withColumn("percent", percent(F.col("count"), F.col("_all"))).drop("_all")


def toxic_distribution(counts: DataFrame, clean: DataFrame) -> DataFrame:
    """Toxic totals by type over the clean comments of the domain. clean: domain, total_clean."""
    per = counts.groupBy("domain", "toxic_type").agg(F.sum("n").alias("count"))
    return per.join(clean, "domain").withColumn("percent", percent(F.col("count"), F.col("total_clean"))).drop("total_clean")


def top_events(events: DataFrame, n: int = 10) -> DataFrame:
    """Events with most clean comments per domain."""
    return top_rows(events.filter("analysed"), ["domain"], [F.col("clean").desc(), F.col("id_content")], n, "rank")


def merge_analysis(web: DataFrame, summaries: DataFrame, fields: list[str]) -> DataFrame:
    """Web events with their summary nested as `analyzed` (null without one)."""
    s = summaries.select("id_content", F.struct(*fields).alias("analyzed"))
    return web.join(s, "id_content", "left")


def unknown_summaries(web: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries of events nobody knows: reported, not merged."""
    return summaries.join(web, "id_content", "left_anti")


def next_ids(ids: DataFrame) -> DataFrame:
    """Largest numeric suffix per domain prefix, and the next id."""
    d = F.regexp_extract("id_content", r"^([a-z]+)_", 1)
    n = F.regexp_extract("id_content", r"_(\d+)", 1).try_cast("long")
    out = ids.select(d.alias("domain"), n.alias("n")).filter("domain <> '' and n is not null").groupBy("domain").agg(F.max("n").alias("last"))
    return out.withColumn("next_id", F.concat("domain", F.lit("_"), F.lpad((F.col("last") + 1).cast("string"), F.greatest(F.lit(3), F.length((F.col("last") + 1).cast("string"))), F.lit("0"))))
