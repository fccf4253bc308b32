"""Session memory against a loop over each user's turns; the number of micro-batches does not matter."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.streaming import jobs, memory


def brute(rows, passed):
    out, state = [], {}
    for user, t, seq, q, a, ids in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if t * 1000 >= passed:
            continue
        turn, latest, recent, carried = state.get(user, (0, None, [], []))
        if latest is not None and t - latest > 1_800_000:
            turn, recent, carried = 0, [], []
        out.append((user, seq, turn + 1, tuple(recent), tuple(carried)))
        state[user] = (turn + 1, t, [*recent, (q, a)][-3:], ids or carried)
    return sorted(out)


@pytest.mark.parametrize("files", [1, 4, 40])
def test_memory_does_not_depend_on_batches(spark, tmp_path, files):
    r = random.Random(5)
    rows, clock = [], 0
    for i in range(400):   # times in milliseconds, up to four minutes out of order, one hot user
        clock += r.choice([1_000, 60_000, 600_000])
        user = r.choice(["hot", "hot", "hot", "a", "b", "c"])
        rows.append((user, max(0, clock - r.randint(0, 240_000)), i, r.choice(["q", None, "é"]), f"a{i}", r.choice([None, [], [f"e{i}"], [f"e{i}", "x"]])))
    schema = "user string, t long, seq long, q string, a string, ids array<string>"
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_millis("t")).drop("t").coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    stream = jobs.source(spark, f"{tmp_path}/in", "*.parquet", "user string, seq long, q string, a string, ids array<string>, ts timestamp", files=1)
    found = jobs.appended(memory.session_memory(stream, "user", "seq", "q", "a", "ids"), "memory").collect()
    got = sorted((x["user"], x["seq"], x["turn"], tuple((p["question"], p["answer"]) for p in x["recent"]), tuple(x["carried"] or [])) for x in found)
    want = brute(rows, (max(x[1] for x in rows) - 600_000) * 1000)
    assert got == want and len(want) > 300
    assert max(g[2] for g in got) > 3 and any(g[2] == 1 and g[0] == "hot" for g in got[1:])
