"""Reply graphs: valid nodes and edges, structural counts, neighbour means, property-graph rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.operators.ordering import first_row


def usable(df: DataFrame, labels: list[str]) -> DataFrame:
    """Not noise, and a known label."""
    return df.filter(~F.col("is_trash") & F.col("label").isin(labels))


def reply_edges(nodes: DataFrame) -> DataFrame:
    """(event_id, child, parent) where both ends are nodes."""
    ends = nodes.select("event_id", F.col("comment_id").alias("parent_id"))
    return nodes.select("event_id", F.col("comment_id").alias("child"), "parent_id").join(
        ends, ["event_id", "parent_id"]).select("event_id", "child", F.col("parent_id").alias("parent"))


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """depth, in_degree and sibling_count per node. Counts are grouped first, so a parent with very many
    replies is one small row; a window over the siblings would gather them all. Nodes without a valid parent
    are siblings of each other within their event."""
    parent = edges.select("event_id", F.col("child").alias("comment_id"), F.col("parent").alias("valid_parent"))
    n = nodes.join(parent, ["event_id", "comment_id"], "left")
    replies = edges.groupBy("event_id", F.col("parent").alias("comment_id")).agg(F.count("*").alias("in_degree"))
    family = F.coalesce(F.col("valid_parent"), F.lit("ROOT"))
    size = n.groupBy("event_id", family.alias("_family")).agg((F.count("*") - 1).alias("sibling_count"))
    return n.withColumn("_family", family).join(size, ["event_id", "_family"]).join(
        replies, ["event_id", "comment_id"], "left").withColumn(
        "in_degree", F.coalesce("in_degree", F.lit(0))).drop("_family", "valid_parent")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverse as (event_id, src, dst)."""
    return edges.select("event_id", F.col("child").alias("src"), F.col("parent").alias("dst")).unionByName(
        edges.select("event_id", F.col("parent").alias("src"), F.col("child").alias("dst")))


def neighbour_mean(nodes: DataFrame, edges: DataFrame, vector: str = "x") -> DataFrame:
    """Mean of the neighbour vectors per node (zeros without neighbours), of vectors of any length: components are
    averaged as rows, with partial sums before the shuffle, and put together per node."""
    src = nodes.select("event_id", F.col("comment_id").alias("src"), F.col(vector).alias("_v"))
    sent = both_ways(edges).join(src, ["event_id", "src"]).select("event_id", F.col("dst").alias("comment_id"), F.posexplode("_v").alias("_i", "_c"))
    cells = sent.groupBy("event_id", "comment_id", "_i").agg(F.avg("_c").alias("_c"))
    means = cells.groupBy("event_id", "comment_id").agg(F.array_sort(F.collect_list(F.struct("_i", "_c"))).alias("_m"))
    zeros = F.transform(vector, lambda _: F.lit(0.0))
    mean = F.coalesce(F.transform("_m", lambda x: x["_c"]), zeros)
    return nodes.join(means, ["event_id", "comment_id"], "left").withColumn("mean", mean).drop("_m")


def products(x: Column, weights: list[np.ndarray]) -> Column:
    """W x for each matrix W, concatenated: one matrix product per Arrow batch."""
    stacked = np.vstack(weights)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(xs: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(xs.to_numpy()).astype("float64") @ stacked.T))
    return apply(x)


def encode(nodes: DataFrame, edges: DataFrame, layers: list[dict], head: dict) -> DataFrame:
    """Two-layer mean-neighbour encoder with given weights and a linear head: adds logits. Each layer is
    {l, r, b} for relu(l mean(neighbours) + r x + b); head is {w, b}. l is applied before the mean (both are
    linear), so neighbours exchange the short hidden vectors instead of the long inputs."""
    x = nodes
    for layer in layers:
        dim = layer["l"].shape[0]
        x = x.withColumn("_p", products(F.col("x"), [layer["l"], layer["r"]]))
        x = x.withColumn("_n", F.slice("_p", 1, dim)).withColumn("_own", F.slice("_p", dim + 1, dim))
        bias = F.array(*[F.lit(float(v)) for v in layer["b"]])
        m = neighbour_mean(x, edges, "_n")
        total = F.zip_with(F.zip_with("mean", "_own", lambda a, b: a + b), bias, lambda a, b: F.greatest(a + b, F.lit(0.0)))
        x = m.withColumn("x", total).drop("mean", "_p", "_n", "_own")
    shift = F.array(*[F.lit(float(v)) for v in head["b"]])
    return x.withColumn("logits", F.zip_with(products(F.col("x"), [head["w"]]), shift, lambda a, b: a + b))


def disagreements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Reply edges whose ends carry different labels."""
    side = lambda who: nodes.select("event_id", F.col("comment_id").alias(who), F.col("label").alias(f"{who}_label"))
    return edges.join(side("child"), ["event_id", "child"]).join(side("parent"), ["event_id", "parent"]).filter(
        F.col("child_label") != F.col("parent_label"))


def most_replied(edges: DataFrame, nodes: DataFrame, n: int = 10) -> DataFrame:
    top = edges.groupBy("event_id", F.col("parent").alias("comment_id")).agg(F.count("*").alias("replies")).orderBy(
        F.col("replies").desc(), "event_id", "comment_id").limit(n)
    return nodes.join(F.broadcast(top), ["event_id", "comment_id"])


def longest_chains(threads: DataFrame, n: int = 10) -> DataFrame:
    return threads.withColumn("depth", F.col("level") - 1).orderBy(
        F.col("depth").desc(), "event_id", "comment_id").limit(n)


def wrong_predictions(pred: DataFrame, split: str = "test") -> DataFrame:
    return pred.filter((F.col("split") == split) & (F.col("pred_label") != F.col("true_label")))


def uid(event: Column, comment: Column) -> Column:
    return F.concat_ws("::", event, comment)


def property_rows(nodes: DataFrame, edges: DataFrame, domain: Column) -> dict[str, DataFrame]:
    """Event, Comment and Label vertices and the three relations. Of rows with one (event, comment) id the last
    wins; duplicates are counted."""
    keyed = nodes.withColumn("uid", uid(F.col("event_id"), F.col("comment_id"))).withColumn("domain", domain)
    last = first_row(keyed, ["uid"], [F.col("seq").desc()]).withColumn("label_key", F.concat_ws("::", "domain", "label"))
    return {
        "events": last.select(F.col("event_id").alias("id"), "domain").distinct(),
        "comments": last,
        "labels": last.select(F.col("label_key").alias("key"), F.col("label").alias("name"), "domain").distinct(),
        "in_event": last.select("uid", "event_id"),
        "has_label": last.select("uid", "label_key"),
        "reply_to": edges.select(uid(F.col("event_id"), F.col("child")).alias("child"),
                                 uid(F.col("event_id"), F.col("parent")).alias("parent")).distinct(),
        "duplicates": keyed.groupBy("uid").agg((F.count("*") - 1).alias("n")).filter("n > 0"),
    }
