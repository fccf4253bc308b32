"""Thread statistics, event summaries and the views built on them. Input: labelled comments (event_id, domain,
comment_id, root_id, level, text, likes, reply_count, is_trash, label, toxic, toxic_type, label_source, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy import vocab
from canopy.functions.text import clip, percent, round_exact, strip
from canopy.operators.ordering import first_row, top_rows

def valid() -> Column:
    return ~F.col("is_trash")


def rank_score() -> Column:
    return F.coalesce("likes", F.lit(0)) + F.coalesce("reply_count", F.lit(0))


def label_columns(labels: list[str], prefix: str = "n") -> list[Column]:
    """One zero-filled count per label."""
    return [F.count_if(valid() & (F.col("label") == lab)).alias(f"{prefix}_{i}") for i, lab in enumerate(labels)]


def thread_stats(df: DataFrame, toxic: bool = True) -> DataFrame:
    """Size, valid comments, label counts, toxic count and controversy per thread. Counted per label first, so a
    hot thread arrives as a few rows."""
    per = df.groupBy("event_id", "root_id", "label").agg(
        F.count("*").alias("n"), F.count_if(valid()).alias("v"), F.count_if(valid() & F.col("toxic")).alias("t"))
    named = F.col("label").isNotNull() & (F.col("v") > 0)
    out = per.groupBy("event_id", "root_id").agg(
        F.sum("n").alias("size"), F.sum("v").alias("total"), F.sum("t").alias("toxic_count"),
        F.coalesce(F.max(F.when(named, F.col("v"))), F.lit(0)).alias("top"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(named, F.struct("label", "v"))))).alias("labels"))
    split = (F.col("total") > 1) & (F.col("top") / F.col("total") < vocab.CONTROVERSIAL_RATIO)
    out = out.withColumn("controversial", split).drop("top")
    return out if toxic else out.drop("toxic_count")


def label_counts(df: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Valid comments per key and fixed label as rows, zeros included."""
    counts = df.groupBy(*keys).agg(*label_columns(labels))
    rows = F.array(*[F.struct(F.lit(lab).alias("label"), F.col(f"n_{i}").alias("n")) for i, lab in enumerate(labels)])
    return counts.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.label", "r.n")


def emotion_summary(df: DataFrame) -> DataFrame:
    """Per event: valid comments, zero-filled label counts, toxic counts by type."""
    labels = vocab.LABELS["showbiz"]
    bad = valid() & F.col("toxic")
    c = df.groupBy("event_id").agg(
        F.count_if(valid()).alias("total_comments"), *label_columns(labels), F.count_if(bad).alias("total_toxic"),
        *[F.count_if(bad & (F.col("toxic_type") == t)).alias(f"x_{i}") for i, t in enumerate(vocab.TOXIC_TYPES)])
    as_map = lambda names, prefix: F.map_from_arrays(
        F.array(*map(F.lit, names)), F.array(*[F.col(f"{prefix}_{i}") for i in range(len(names))]))
    return c.select("event_id", "total_comments", as_map(labels, "n").alias("emotion_stats"), "total_toxic",
                    as_map(vocab.TOXIC_TYPES, "x").alias("toxic_stats"))


def stance_summary(df: DataFrame) -> DataFrame:
    """Per event and stance: count and its share of valid comments; plus noise and totals."""
    labels = vocab.LABELS["education"]
    c = df.groupBy("event_id").agg(F.count_if("is_trash").alias("trash"), *label_columns(labels))
    c = c.withColumn("total_valid", sum((F.col(f"n_{i}") for i in range(len(labels))), F.lit(0)))
    rows = F.array(*[F.struct(F.lit(lab).alias("label"), F.col(f"n_{i}").alias("count")) for i, lab in enumerate(labels)])
    return c.select("event_id", "trash", "total_valid", (F.col("total_valid") + F.col("trash")).alias("total"),
                    F.explode(rows).alias("r")).select(
        "event_id", "total", "trash", "total_valid", "r.label", "r.count",
        percent(F.col("r.count"), F.col("total_valid")).alias("percent"))


def label_sources(df: DataFrame) -> DataFrame:
    return df.groupBy("event_id", "label_source").agg(F.count("*").alias("n"))


def popular(df: DataFrame, n: int = 3) -> DataFrame:
    """Most liked and answered valid roots per event."""
    top = df.filter(valid() & (F.col("level") == 1)).withColumn("score", rank_score())
    return top_rows(top, ["event_id"], [F.col("score").desc(), F.col("seq")], n, "rank")


def best_per_label(df: DataFrame, labels: list[str]) -> DataFrame:
    """The best valid root of each label per event."""
    top = df.filter(valid() & (F.col("level") == 1) & F.col("label").isin(labels)).withColumn("score", rank_score())
    return first_row(top, ["event_id", "label"], [F.col("score").desc(), F.col("seq")])


def examples(df: DataFrame, labels: list[str], n: int = 3, chars: int = 150, likes_only: bool = False) -> DataFrame:
    """Up to n texts of valid roots per event and label, best first."""
    score = F.coalesce("likes", F.lit(0)) if likes_only else rank_score()
    top = df.filter(valid() & (F.col("level") == 1) & F.col("label").isin(labels)).withColumn("score", score)
    out = top_rows(top, ["event_id", "label"], [F.col("score").desc(), F.col("seq")], n, "rank")
    return out.withColumn("example", F.substring("text", 1, chars))


def longest(df: DataFrame, labels: list[str], n: int = 5, chars: int = 400) -> DataFrame:
    """Up to n longest valid roots per event and label."""
    top = df.filter(valid() & (F.col("level") == 1) & F.col("label").isin(labels)).withColumn("chars", F.length("text"))
    out = top_rows(top, ["event_id", "label"], [F.col("chars").desc(), F.col("seq")], n, "rank")
    return out.withColumn("shown", clip(F.col("text"), chars))


def largest_threads(df: DataFrame, stats: DataFrame, n: int = 15, chars: int = 400) -> DataFrame:
    """Largest threads per event with the text of their root."""
    top = top_rows(stats, ["event_id"], [F.col("size").desc(), F.col("root_id")], n, "rank")
    root = df.select("event_id", F.col("comment_id").alias("root_id"), F.col("text").alias("_t"))
    return top.join(root, ["event_id", "root_id"], "left").withColumn("root_text", clip(F.col("_t"), chars)).drop("_t")


def post_totals(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Totals shown for one analysed post."""
    bad = valid() & F.col("toxic")
    n = df.groupBy("event_id").agg(
        F.count("*").alias("comments"), F.count_if(F.col("level") == 1).alias("top_level"),
        F.count_if(F.col("level") > 1).alias("replies"), F.count_if("is_trash").alias("trash"),
        F.count_if(valid()).alias("valid"), F.count_if(bad).alias("toxic_total"),
        *[F.count_if(bad & (F.col("toxic_type") == t)).alias(f"toxic_{i}") for i, t in enumerate(vocab.TOXIC_TYPES)])
    c = stats.groupBy("event_id").agg(F.count("*").alias("clusters"), F.count_if("controversial").alias("controversial"))
    ratio = F.when(F.col("valid") > 0, round_exact(F.col("toxic_total") / F.col("valid"), 3) / 1000).otherwise(0.0)
    return n.join(c, "event_id").withColumn("toxic_ratio", ratio)


def representative(candidates: DataFrame, n: int = 12) -> DataFrame:
    """First n candidates per event, skipping one whose id or text was already taken. candidates: event_id, pos,
    comment_id, text, label - the few picks of the summary (examples or best and most popular), so an event's
    list is short by construction and is folded in order."""
    c = candidates.withColumn("text", strip(F.coalesce("text", F.lit("")))).filter("text <> ''")
    lists = c.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("pos", "comment_id", "text", "label"))).alias("cs"))
    taken = F.aggregate(
        "cs", F.filter("cs", lambda x: F.lit(False)),
        lambda acc, x: F.when(
            (F.size(acc) < n) & ~F.exists(acc, lambda y: (y["text"] == x["text"]) | F.coalesce(y["comment_id"] == x["comment_id"], F.lit(False))),
            F.concat(acc, F.array(x))).otherwise(acc))
    return lists.select("event_id", F.posexplode(taken).alias("i", "c")).select("event_id", "i", "c.comment_id", "c.text", "c.label")


def normal_distribution(counts: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Label counts for display. counts: event_id, domain, label, n (label may be 'total' or noise), declared
    (education: total incl. noise; showbiz: valid total). Spellings of one label merge; what no label covers
    becomes its own row; shares are of valid comments."""
    key = F.lower(F.regexp_replace(strip(F.col("label")), "[_ ]+", " "))
    canon = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), key), key) if aliases else key
    c = counts.withColumn("label", canon)
    heads = c.groupBy("event_id", "domain").agg(
        F.max("declared").alias("declared"), F.sum(F.when(F.col("label") == vocab.TRASH, F.col("n")).otherwise(0)).alias("trash"),
        F.sum(F.when(~F.col("label").isin("total", vocab.TRASH), F.col("n")).otherwise(0)).alias("classified"))
    edu = F.col("domain") == "education"
    heads = heads.withColumn("valid", F.when(edu, F.coalesce("declared", F.col("classified") + F.col("trash")) - F.col("trash"))
                             .otherwise(F.coalesce("declared", "classified")))
    groups = c.filter(~F.col("label").isin("total", vocab.TRASH)).groupBy("event_id", "label").agg(F.sum("n").alias("n"))
    rest = heads.filter("valid > classified").select("event_id", F.lit("chưa phân loại").alias("label"), (F.col("valid") - F.col("classified")).alias("n"))
    return groups.unionByName(rest).join(heads, "event_id").withColumn("consistent", F.col("valid") >= F.col("classified")).withColumn(
        "percent", F.when(F.col("valid") > 0, F.col("n") / F.col("valid") * 100).otherwise(0.0))
