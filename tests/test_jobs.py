import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from canopy import session
from canopy.operators import cleaning, curation, merge_state, near_copies, search
from canopy.session import cut
from canopy.streaming import jobs


def test_cleaning_order(spark):
    rows = [(0, "CLICK HERE NOW click here"), (1, "CLICK HERE NOW click here"), (2, None), (3, "x"), (4, "gọi 0912345678 hoặc a.b@c.vn nhé"), (5, "a​b  ć"),
            (6, "ab ć"), (7, "TOÀN CHỮ HOA"), (8, "http://a http://b http://c")]
    m = cut(cleaning.mark_records(spark.createDataFrame(rows, "seq long, text string")))
    got = {r["seq"]: r["status"] for r in m.collect()}
    assert got == {0: "spam", 1: "exact_dup", 2: "missing_field:text", 3: "text_too_short", 4: "clean", 5: "clean", 6: "exact_dup", 7: "spam", 8: "spam"}
    c = {r["seq"]: r for r in cleaning.clean_records(m).collect()}
    assert c[4]["clean_text"] == "gọi [REDACTED_PHONE] hoặc [REDACTED_EMAIL] nhé" and (c[4]["phones"], c[4]["emails"]) == (1, 1)
    again = cleaning.mark_records(spark.createDataFrame(rows, "seq long, text string"), prior=cleaning.prior_hashes(cleaning.clean_records(m)))
    assert {r["seq"] for r in again.filter("status = 'cross_run_dup'").collect()} == {1, 4, 5, 6}
    legacy = cleaning.prior_hashes(cleaning.clean_records(m), legacy_hash=True)
    again = cleaning.mark_records(spark.createDataFrame(rows, "seq long, text string"), prior=legacy)
    assert {r["seq"] for r in again.filter("status = 'cross_run_dup'").collect()} == {1, 5, 6}


def brute(rows, t=0.8):
    kept = []
    for seq, text in sorted(rows):
        words = {w for w in "".join(ch if ch.isalnum() else " " for ch in text.lower()).split()}
        if all(len(words & k) / max(1, len(words | k)) <= t and words != k for _, k in kept):
            kept.append((seq, words))
    return {s for s, _ in kept}


def test_near_copies_equal_the_walk(spark, monkeypatch):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 25))] for _ in range(12)]
    rows = []
    for seq in range(150):
        words = list(base[0] if seq % 3 == 0 else rng.choice(base))  # a third of the rows are variants of one text
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
        rows.append((seq, " ".join(words)))
    df = spark.createDataFrame(rows, "seq long, text string")
    want = brute(rows)
    for bucket in (8, 1000):  # rounds over crowded tokens first, and pairs only
        monkeypatch.setattr(near_copies, "BUCKET", bucket)
        monkeypatch.setattr(near_copies, "PER_SALT", 3)
        assert {r["seq"] for r in near_copies.drop_near_copies(df).collect()} == want


def test_rounds_that_decide_few_rows_end(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(seq, " ".join(rng.sample([f"w{i}" for i in range(14)], rng.randrange(5, 11)))) for seq in range(80)]  # unlike texts of common words
    rows += [(None, "w1 w2 w3"), (200, ""), (201, None)]
    df = spark.createDataFrame(rows, "seq long, text string")
    monkeypatch.setattr(near_copies, "BUCKET", 3)
    monkeypatch.setattr(near_copies, "PROGRESS", 0.5)
    asked, crowded = [], near_copies._crowded
    monkeypatch.setattr(near_copies, "_crowded", lambda open_: asked.append(1) or crowded(open_))
    got = {r["seq"] for r in near_copies.drop_near_copies(df).collect()}
    assert got - {None} == brute([(s, t or "") for s, t in rows if s is not None]) and len(asked) <= 3


def test_sketches_differ_in_no_more_bits_than_sets_in_words(spark):
    rng = random.Random(7)
    sets = [sorted(rng.sample([f"w{i}" for i in range(60)], rng.randrange(1, 40))) for _ in range(30)]
    marks = {r["seq"]: r for r in near_copies.sketches(spark.createDataFrame(list(enumerate(sets)), "seq long, words array<string>")).collect()}
    for i, a in enumerate(sets):
        assert marks[i]["n"] == len(a)
        for j, b in enumerate(sets):
            apart = sum(((marks[i][f"s{k}"] ^ marks[j][f"s{k}"]) & (2**64 - 1)).bit_count() for k in range(near_copies.SKETCH))
            assert apart <= len(set(a) ^ set(b))


@pytest.mark.parametrize("block_terms", [40, 400_000])
def test_scores_and_matches(spark, monkeypatch, block_terms):
    monkeypatch.setattr(search, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(search, "EVENTS", 7)
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(60)]
    pick = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(60)], k=n))
    events = spark.createDataFrame([(i, pick(4), "", pick(30)) for i in range(80)], "event_id long, title string, actors string, content string")
    messages = spark.createDataFrame([(i, pick(8)) for i in range(25)], "query_id long, message string")
    post = cut(search.postings(events))
    idf = cut(search.idf(post, events.count()))
    q = search.query_terms(messages, idf)
    weight = F.when(F.col("head"), 3.0).otherwise(1.0)
    full = q.join(post, "term").groupBy("query_id", "event_id").agg(
        F.sum((weight * F.col("idf")).cast("decimal(20,12)")).alias("score"), F.bool_or("head").alias("head_hit"))
    want = {(r["query_id"], r["event_id"]): (r["score"], r["head_hit"]) for r in full.collect()}
    got = {(r["query_id"], r["event_id"]): (r["score"], r["head_hit"]) for r in search.scores(messages, post, idf).collect()}
    assert got == want and len(got) > 500


def stream_of(spark, folder, rows, files):
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, "key string, k int, t long").select("key", "k", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    schema = "key string, k int, ts timestamp"
    return jobs.source(spark, folder, "*.parquet", schema, files=1)


@pytest.mark.parametrize("files", [1, 4])
def test_streams_do_not_depend_on_batches(spark, tmp_path, files):
    rng = random.Random(1)
    rows = sorted(((rng.choice("abc"), rng.randint(0, 3), rng.randint(0, 40_000)) for _ in range(300)), key=lambda r: r[2])
    stream = stream_of(spark, str(tmp_path / "in"), rows, files)
    want, last = [], {}
    for key, k, t in rows:
        name = ("week|" if k > 1 else "year|") + key
        if name not in last or t > last[name] + 1800:
            last[name] = t
            want.append((name, t))
    got = jobs.appended(jobs.fresh_queries(stream, F.col("key"), F.col("k") > 1), "fresh").select("key", F.unix_seconds("ts")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 40
    work = jobs.incremental(stream, ["key", "k"], {"n": merge_state.counted()}, str(tmp_path / "counts"))
    n = merge_state.current(spark, str(tmp_path / "counts"))
    assert {(r["key"], r["k"]): r["n"] for r in n.collect()} == Counter((key, k) for key, k, _ in rows)
    assert len(work) == files
    store = str(tmp_path / "store")
    first = jobs.unseen(stream, F.concat_ws("|", "key", "k"), store, buckets=4)
    assert first.count() == len({(key, k) for key, k, _ in rows})
    assert jobs.unseen(stream, F.concat_ws("|", "key", "k"), store).count() == 0   # a later stream over the same store
    recent = jobs.appended(jobs.recently_unseen(stream, F.col("key"), "10 days"), "recent")
    assert recent.count() == len({key for key, _, _ in rows})


def test_a_cluster_without_shared_folder_is_refused():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


def test_fitted_split_keeps_groups_together(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", f"e{min(int(rng.expovariate(0.15)), 25)}", rng.choice("aab")) for i in range(600)]
    out = cut(curation.fitted_group_split(spark.createDataFrame(rows, "id string, event_id string, label string"), "event_id", "label", tries=40))
    assert out.count() == 600
    assert out.groupBy("event_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert set(n) == {"train", "val", "test"} and n["test"] >= 90 and n["val"] >= 90 and n["train"] > 300
