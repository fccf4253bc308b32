"""Event documents: what serving reads per event. Input: labelled comments as in summaries.

Lists inside a document are bounded (labels, three comments, three examples); comments and clusters, of which an event
may have any number, stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy import vocab
from canopy.operators import summaries


def _map(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(event_id, name) with the rows of an event as one map; keys are labels or label sources."""
    entry = F.struct(F.col(key).alias("k"), value.alias("v"))
    return rows.filter(F.col(key).isNotNull()).groupBy("event_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


def full_comments(df: DataFrame) -> DataFrame:
    """Comments with place, label and label source, as they are stored per domain."""
    return df.select("event_id", "domain", "comment_id", "root_id", "level", "text", "likes", "reply_count", "is_trash", "label", "toxic", "toxic_type", "label_source")


def clusters(df: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per thread: size, statistics, whether it is controversial, its root's text, and its summary from texts
    (event_id, root_id, summary; '' where missing)."""
    stats = summaries.thread_stats(df)
    root = df.select("event_id", F.col("comment_id").alias("root_id"), F.col("text").alias("root_text"))
    out = stats.join(root, ["event_id", "root_id"], "left").withColumn("root_text", F.coalesce("root_text", F.lit("")))
    if texts is None:
        return out.withColumn("summary", F.lit(""))
    return out.join(texts.select("event_id", "root_id", "summary"), ["event_id", "root_id"], "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def _sources(df: DataFrame) -> DataFrame:
    return _map(summaries.label_sources(df), "label_source", F.col("n"), "label_sources")


def showbiz_documents(df: DataFrame) -> DataFrame:
    """One row per event: label_sources, total_comments, emotion_stats, toxic_stats with total_toxic, and top_comments
    (three most popular valid roots, and the best of each label). Controversial threads are rows of clusters."""
    base = summaries.emotion_summary(df)
    toxic = F.map_concat(F.create_map(F.lit("total_toxic"), F.col("total_toxic")), F.col("toxic_stats"))
    base = base.select("event_id", "total_comments", "emotion_stats", toxic.alias("toxic_stats"))
    one = F.struct("rank", "comment_id", "text", "likes", "reply_count", "score", F.col("label").alias("emotion"))
    popular = summaries.popular(df).groupBy("event_id").agg(F.array_sort(F.collect_list(one)).alias("most_popular"))
    best = _map(summaries.best_per_label(df, vocab.LABELS["showbiz"]), "label", F.struct("comment_id", "text", "score"), "by_emotion")
    out = base.join(_sources(df), "event_id", "left").join(popular, "event_id", "left").join(best, "event_id", "left")
    return out.withColumn("top_comments", F.struct("most_popular", "by_emotion")).drop("most_popular", "by_emotion")


def education_documents(df: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """One row per event: label_sources, comment_counts (labels, noise, total), analysis per label (count, percent of
    valid comments, summary, up to three examples) and conclusion. digests: event_id, summaries (label -> text), focus,
    trend, from the event's own request; texts are '' without it."""
    labels = vocab.LABELS["education"]
    rows = summaries.stance_summary(df)
    if digests is None:
        rows = rows.withColumns({"summary": F.lit(""), "focus": F.lit(""), "trend": F.lit("")})
    else:
        rows = rows.join(digests, "event_id", "left").withColumn("summary", F.coalesce(F.try_element_at("summaries", F.col("label")), F.lit("")))
        rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("focus", "trend")})
    shown = summaries.examples(df, labels).groupBy("event_id", "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "example"))), lambda x: x["example"]).alias("examples"))
    rows = rows.join(shown, ["event_id", "label"], "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    entry = lambda *v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", *v))))
    heads = rows.groupBy("event_id").agg(
        F.max("total").alias("total"), F.max("trash").alias("trash"), entry(F.col("count").alias("v")).alias("counts"),
        entry(F.struct("count", "percent", "summary", "examples").alias("v")).alias("analysis"), F.max("focus").alias("focus"), F.max("trend").alias("trend"))
    spelled = F.transform_keys("counts", lambda k, _: F.replace(k, F.lit(" "), F.lit("_")))
    counts = F.map_concat(F.create_map(F.lit("total"), F.col("total"), F.lit(vocab.TRASH), F.col("trash")), spelled)
    return heads.select("event_id", counts.alias("comment_counts"), "analysis", F.struct("focus", "trend").alias("conclusion")).join(_sources(df), "event_id", "left")
