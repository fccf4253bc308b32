"""Runs against a digest store bring each key once, whatever is lost or repeated; unseen keys open no bucket."""

import random

from pyspark.sql import functions as F

from canopy.operators import digest_store
from canopy.sources import versions


def take(spark, path, run, keys, **more):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "name string, i long").repartition(3)
    got, work = digest_store.take(rows, F.col("name"), path, run, order=["i"], **more)
    return sorted((r["key"], r["i"]) for r in got.collect()), work


def test_runs_repeats_and_losses(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digest_store, "MERGE", 2)
    path, r, seen = str(tmp_path / "store"), random.Random(3), set()
    runs = [[f"k{r.randint(0, 300)}" for _ in range(120)] + [None] for _ in range(5)] + [[], ["k1"]]
    merged = 0
    for n, keys in enumerate(runs):
        want = sorted((k, keys.index(k)) for k in set(keys) - seen - {None})
        if n == 2:   # the run is lost before its manifest: nothing of it counts
            with monkeypatch.context() as m:
                m.setattr(versions, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
                try:
                    take(spark, path, n, keys, buckets=8)
                    raise AssertionError("the run should be lost")
                except OSError:
                    pass
        got, work = take(spark, path, n, keys, buckets=8)
        assert got == want
        merged += len(work["merged"])
        assert take(spark, path, n, keys, buckets=8)[0] == want   # again: the same records
        seen |= set(keys) - {None}
    assert merged > 0
    stored = versions.latest(spark, path)[1]["digests"]
    held = spark.read.parquet(*[f for fs in stored.values() for f in fs])
    assert sorted(x["key"] for x in held.collect()) == sorted(seen)


def test_only_buckets_with_known_keys_are_opened(spark, tmp_path):
    path = str(tmp_path / "store")
    take(spark, path, 1, [f"a{i}" for i in range(2000)], buckets=32)
    got, work = take(spark, path, 2, [f"b{i}" for i in range(500)], buckets=32)
    assert len(got) == 500 and len(work["opened"]) <= 2
    got, work = take(spark, path, 3, ["a7", "a8", "new"], buckets=32)
    assert [k for k, _ in got] == ["new"] and 1 <= len(work["opened"]) <= 3 and len(work["folders"]) <= 2 * len(work["opened"])
    assert len(work["touched"]) == 1
