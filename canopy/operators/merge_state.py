"""Results kept as partial aggregates that merge: a batch is aggregated alone and merged into the states of its own keys."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopy.session import cut
from canopy.sources import versions

BUCKETS = 64   # folders that states are spread over; fixed for the life of a store
Parts = dict[str, tuple[Column, Callable[[str], Column]]]   # name -> (aggregate of rows, function that merges two such)


def counted(condition: Column | None = None) -> tuple[Column, Callable[[str], Column]]:
    return (F.count("*") if condition is None else F.count_if(condition)), F.sum


def summed(value: Column) -> tuple[Column, Callable[[str], Column]]:
    return F.sum(value), F.sum


def least(value: Column) -> tuple[Column, Callable[[str], Column]]:
    return F.min(value), F.min


def most(value: Column) -> tuple[Column, Callable[[str], Column]]:
    return F.max(value), F.max


def merge(batch: DataFrame, keys: list[str], parts: Parts, path: str, run: int, buckets: int = BUCKETS) -> dict[str, int]:
    """Merges a batch into the states (keys, parts) at path as version run; returns how many rows were read and written.

    The batch is aggregated on its own, map side first, so a hot key moves one row per task. Of the states only the buckets that its
    keys fall into are read, merged and written as new folders; all others stay. The manifest is published last: until then, and
    after a lost batch, readers have the version before. A batch that is run again merges into the version before its own, so it
    counts once. Null keys are keys. An empty batch changes nothing.
    """
    spark = batch.sparkSession
    before = versions.latest(spark, path, before=run)
    state = before[1] if before else {"buckets": buckets, "folders": {}, "schema": None}
    buckets = state["buckets"]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    added = cut(batch.groupBy(*keys).agg(*[how.alias(n) for n, (how, _) in parts.items()]).select("*", bucket), "partial")
    touched = sorted(r["_bucket"] for r in added.select("_bucket").distinct().collect())
    if not touched:
        versions.publish(spark, path, run, state)
        return {"read": 0, "written": 0, "buckets": 0}
    schema = added.drop("_bucket").schema
    old = [state["folders"][str(b)] for b in touched if str(b) in state["folders"]]
    held = spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema)
    both = added.unionByName(held.select("*", bucket))
    merged = both.groupBy(*keys, "_bucket").agg(*[how(n).alias(n) for n, (_, how) in parts.items()])
    folder = f"{path}/state/run-{run:012d}-{uuid.uuid4().hex[:8]}"
    merged.select(*[F.col(f.name).cast(f.dataType) for f in schema], "_bucket").repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    folders = {**state["folders"], **{str(b): f"{folder}/_bucket={b}" for b in touched}}
    versions.publish(spark, path, run, {"buckets": buckets, "folders": folders, "schema": schema.json()})
    return {"read": held.count(), "written": spark.read.parquet(folder).count(), "buckets": len(touched)}


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The states of the newest version, None where there are none yet."""
    found = versions.latest(spark, path)
    if found is None or not found[1]["folders"]:
        return None
    return spark.read.schema(StructType.fromJson(json.loads(found[1]["schema"]))).parquet(*sorted(found[1]["folders"].values()))
