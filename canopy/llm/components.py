"""Connected components by rounds of hooking and pointer jumping; rounds grow with the logarithm of a chain's length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the undirected edges; label is the smallest node of its component.

    Self-loops, repeated edges and edges with a null end are harmless; no edges give an empty result. Each round joins
    edges to the labels of their far ends, keeps minima (combined before the shuffle, so a hub is no hot spot) and is
    written to the shared folder; the driver only sees how many labels changed.
    """
    one_way = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    both = cut(one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("f")), "labels")
    while True:
        up = labels.select(F.col("u").alias("p"), F.col("f").alias("g"))
        jumped = labels.join(up, labels.f == up.p, "left").select("u", "f", F.coalesce("g", "f").alias("g"))
        jumped = cut(jumped, "jumped")
        near = both.join(jumped.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        hooked = jumped.join(near, "u").select("u", "f", "g", "m")
        offers = hooked.select("u", F.least("g", "m").alias("f")).unionByName(hooked.select(F.col("f").alias("u"), F.col("m").alias("f")))
        fresh = cut(offers.groupBy("u").agg(F.min("f").alias("f")), "labels")
        old = labels.select("u", F.col("f").alias("was"))
        changed = fresh.join(old, "u").filter("f <> was").limit(1).count()
        labels = fresh
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("f").alias("label"))
