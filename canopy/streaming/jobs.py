"""Stream jobs: incremental versions of the jobs that need state between runs.

Every job reads a file source, keeps its state behind a watermark, and is run until its input is used up
(availableNow). Results land as parquet in the shared folder, one folder per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from canopy.operators import digest_store, merge_state
from canopy.operators.ordering import first_row, last_before, running_sum
from canopy.session import run_dir
from canopy.sources import versions


def source(spark: SparkSession, folder: str, pattern: str, schema, files: int | None = None) -> DataFrame:
    """Parquet files as a stream, oldest first; at most files of them in one micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def _run(stream: DataFrame, mode: str, name: str, write: Callable[[DataFrame, int, str], None]) -> str:
    spark = stream.sparkSession
    out, state = run_dir(spark, name), run_dir(spark, f"{name}-state")
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", state)
         .foreachBatch(lambda df, batch: write(df, batch, out)).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def _batch_table(df: DataFrame, batch: int, out: str) -> None:
    df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def appended(stream: DataFrame, name: str) -> DataFrame:
    """All rows an append-mode stream emits."""
    out = _run(stream, "append", name, _batch_table)
    return stream.sparkSession.read.schema(stream.schema).option("basePath", out).parquet(f"{out}/*").drop("batch")


def latest(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The last state of every key an update-mode stream emits, open windows included."""
    out = _run(stream, "update", name, _batch_table)
    rows = stream.sparkSession.read.option("basePath", out).parquet(f"{out}/*")
    return first_row(rows, keys, [F.col("batch").desc()]).drop("batch")


def unseen(stream: DataFrame, key: Column, store: str, name: str = "unseen", **sizes) -> DataFrame:
    """The first record of every key, across runs, with its key. Keys are remembered for good in a digest store (operators.digest_store):
    a micro-batch opens only the buckets that may hold its keys, and one that is run again brings the same records. Micro-batches
    of one store are numbered on from the last one."""
    spark = stream.sparkSession
    last = versions.latest(spark, store)
    start = last[0] + 1 if last else 0

    def write(df: DataFrame, batch: int, out: str) -> None:
        _batch_table(digest_store.take(df, key, store, start + batch, **sizes)[0], batch, out)

    out = _run(stream, "append", name, write)
    return spark.read.option("basePath", out).parquet(f"{out}/*").drop("batch")


def recently_unseen(stream: DataFrame, key: Column, retention: str, ts: str = "ts") -> DataFrame:
    """First record per key within the retention: keys are state behind the watermark and go after it."""
    return stream.withColumn("key", key).withWatermark(ts, retention).dropDuplicatesWithinWatermark(["key"])


def fresh_queries(stream: DataFrame, query: Column, recent: Column, ts: str = "ts", ttl_seconds: int = 1800) -> DataFrame:
    """(key, ts) of the queries that miss the cache: nothing was fetched for the same text and recency before, or the last
    fetch is longer ago than the time to live. A miss is a fetch; hits do not prolong it. The state of a key is the time
    of its last fetch and goes once the watermark has passed its time to live."""
    key = F.concat_ws("|", F.when(recent, "week").otherwise("year"), F.lower(F.substring(F.trim(query), 1, 200)))
    asked = stream.select(key.alias("key"), F.col(ts).alias("ts")).withWatermark("ts", f"{ttl_seconds} seconds")
    ttl = ttl_seconds * 1_000_000

    def fetches(name, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        at = np.sort(np.concatenate([f["micros"].to_numpy() for f in frames]))
        last = state.get[0] if state.exists else None
        missed = []
        i = 0 if last is None else int(np.searchsorted(at, last + ttl, side="right"))
        while i < len(at):
            last = int(at[i])
            missed.append(last)
            i = int(np.searchsorted(at, last + ttl, side="right"))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": [name[0]] * len(missed), "micros": np.asarray(missed, np.int64)})

    found = asked.withColumn("micros", F.unix_micros("ts")).groupBy("key").applyInPandasWithState(
        fetches, "key string, micros long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("key", F.timestamp_micros("micros").alias("ts"))


def volumes(stream: DataFrame, keys: list[str], noise: Column, ts: str = "ts", size: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Comments and noise share per window and key."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    n = F.count("*")
    return stream.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(
        n.alias("n"), F.count_if(noise).alias("noise"), (F.count_if(noise) / n).alias("noise_share"))


def user_sessions(stream: DataFrame, user: str, topic: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Closed sessions per user: turns, and the topic last discussed (carried over turns without one)."""
    return stream.withWatermark(ts, delay).groupBy(user, F.session_window(ts, gap).alias("s")).agg(
        F.count("*").alias("turns"), F.max_by(topic, F.when(F.col(topic).isNotNull(), F.col(ts))).alias("topic")).select(
        user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "turns", "topic")


def incremental(stream: DataFrame, keys: list[str], parts: merge_state.Parts, path: str, name: str = "incremental") -> list[dict]:
    """Keeps aggregates per key up to date (operators.merge_state): every micro-batch is aggregated alone and merged into the states
    of its own keys, so what it reads is bounded by the batch and these states, however long the stream has run. Results do not
    depend on how the input is cut into batches; a micro-batch that is run again counts once. Returns what each one read."""
    last = versions.latest(stream.sparkSession, path)
    start, work = (last[0] + 1 if last else 0), []
    _run(stream, "append", name, lambda df, batch, out: work.append(merge_state.merge(df, keys, parts, path, start + batch)))
    return work


def session_numbers(df: DataFrame, user: str, ts: str, seq: str, gap_seconds: int = 1800, bucket_seconds: int = 3600) -> DataFrame:
    """Batch twin of the sessions: a number per user and session, for users of any size. A turn more than the gap
    after the previous one opens a session."""
    bucket = F.floor(F.unix_seconds(ts) / bucket_seconds)
    rows = last_before(df, [user], [ts, seq], bucket, F.unix_micros(ts), "_prev")
    opens = F.when(F.col("_prev").isNull() | (F.unix_micros(ts) - F.col("_prev") > gap_seconds * 1_000_000), 1).otherwise(0)
    return running_sum(rows, [user], [ts, seq], bucket, opens, "session").drop("_prev")
