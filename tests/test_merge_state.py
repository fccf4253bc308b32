"""States merged batch by batch equal one aggregation; what a batch reads is bounded by the states of its keys."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import merge_state
from canopy.sources import versions

def parts():
    v = F.col("v")
    return {"n": merge_state.counted(), "odd": merge_state.counted(v % 2 == 1), "total": merge_state.summed(v), "low": merge_state.least(v), "high": merge_state.most(v)}


def states(spark, path):
    found = merge_state.current(spark, path)
    return {} if found is None else {(r["event"], r["user"]): tuple(r)[2:] for r in found.collect()}


def brute(rows):
    out = {}
    for e, u, v in rows:
        out.setdefault((e, u), []).append(v)
    known = lambda x: [v for v in x if v is not None]
    return {k: (len(x), sum(v % 2 == 1 for v in known(x)), sum(known(x)) if known(x) else None, min(known(x), default=None), max(known(x), default=None))
            for k, x in out.items()}


def test_batches_losses_and_repeats(spark, tmp_path, monkeypatch):
    path, r, done = str(tmp_path / "states"), random.Random(4), []
    pick = lambda: (r.choice(["hot", "hot", "a", None]), r.randint(0, 5), r.choice([None, *range(9)]))
    batches = [[pick() for _ in range(40)] for _ in range(3)] + [[]] + [[pick() for _ in range(10)]]
    frame = lambda rows: spark.createDataFrame(rows, "event string, user long, v long")
    assert merge_state.current(spark, path) is None
    for run, rows in enumerate(batches):
        if run == 1:   # killed before the manifest: readers keep the old version
            with monkeypatch.context() as m:
                m.setattr(versions, "publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
                with pytest.raises(OSError):
                    merge_state.merge(frame(rows), ["event", "user"], parts(), path, run, buckets=4)
            assert states(spark, path) == brute(done)
        merge_state.merge(frame(rows), ["event", "user"], parts(), path, run, buckets=4)
        merge_state.merge(frame(rows), ["event", "user"], parts(), path, run, buckets=4)   # again: counts once
        done += rows
        assert states(spark, path) == brute(done)


def test_a_batch_reads_the_states_of_its_buckets(spark, tmp_path):
    path = str(tmp_path / "states")
    big = spark.range(5000).select(F.col("id").cast("string").alias("event"), F.lit(1).cast("long").alias("user"), F.lit(1).cast("long").alias("v"))
    merge_state.merge(big, ["event", "user"], parts(), path, 0)
    one = spark.createDataFrame([("7", 1, 5)] * 50, "event string, user long, v long")
    work = merge_state.merge(one, ["event", "user"], parts(), path, 1)
    assert work["buckets"] == 1 and 0 < work["read"] < 200 and work["written"] == work["read"]
    assert states(spark, path)[("7", 1)] == (51, 51, 251, 1, 5) and len(states(spark, path)) == 5000
