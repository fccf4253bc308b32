"""Steps whose cost must not follow the table: micro-batches, calls per user, arrays built below a shuffle."""

import os

import pytest
from pyspark.sql import functions as F

from canopy.functions import text as tx
from canopy.functions import tokens as tk
from canopy.operators import keywords as kw
from canopy.plans import search_queries, serving_queries
from canopy.streaming import memory

ODD = [None, "", "_", "__a__ b_c _d_", "Ab, c_d!  E", "x\t\ny z　", "  đi Ăn_ _cơḿ ", "a\x1cb\x1d_\x1e", "½ ² Ⅷ é_", "İ ı ß", "a\x85b​c", "a _!_ b", "__ __"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id long, text string")


def test_micro_batches_follow_the_cores(spark, tmp_path, monkeypatch):
    rows = spark.range(2000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7).alias("user_id"),
                                    F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(serving_queries, "SLICE_ROWS", 20)
    folder = f"{tmp_path}/run"
    monkeypatch.setattr(serving_queries, "run_dir", lambda spark, name: f"{folder}-{name}")
    serving_queries.event_stream(spark, str(tmp_path))
    slices = sorted(os.listdir(f"{folder}-events"))
    cores = spark.sparkContext.defaultParallelism
    assert 4 <= len(slices) <= -(-2000 // (20 * cores)) + 1
    spans = [spark.read.parquet(f"{folder}-events/{s}").agg(F.min("event_id"), F.max("event_id"), F.count("*")).first() for s in slices]
    assert sum(s[2] for s in spans) == 2000 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert all(len([f for f in os.listdir(f"{folder}-events/{s}") if f.endswith(".parquet")]) == 1 for s in slices)


def test_session_state_is_kept_per_bucket_of_users(spark, tmp_path):
    found = []
    stream = spark.readStream.schema("user long, ts timestamp, seq long, q string, a string, ids array<string>").parquet(str(tmp_path))
    out = memory.session_memory(stream, "user", "seq", "q", "a", "ids")
    found.append(out._jdf.queryExecution().analyzed().toString())
    assert "bucket" in found[0] and dict(out.dtypes)["user"] == "bigint"


def test_arrays_are_not_built_below_the_shuffle_of_a_small_scan(spark, odd, tmp_path):
    odd.coalesce(1).write.parquet(f"{tmp_path}/t")
    spread = spark.read.parquet(f"{tmp_path}/t").repartition(8, "id")
    for rows in (kw.unigram_counts(kw.add_tokens(spread), ["id"]), tk.explode_terms(spread, F.col("text"), "id"), kw.ngram_counts(kw.add_tokens(spread), ["id"], 2)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("RepartitionByExpression"):]
        assert "Filter" not in below, plan


def test_short_classes_give_the_words_of_the_long_ones(odd):
    clean = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), f"[^{tx.WORD}{tx.WS}]+", "")
    clean = F.regexp_replace(clean, f"(?<=^|[{tx.WS}])_+|_+(?=[{tx.WS}]|$)", "")
    packed = F.trim(F.regexp_replace(clean, f"[{tx.WS}]+", " "))
    plain = F.when(packed == "", F.array().cast("array<string>")).otherwise(F.split(packed, " "))
    folded = F.regexp_replace(F.translate(F.lower("text"), tx.FOLD_FROM, tx.FOLD_TO), r"\p{Mn}+", "")
    stripped = F.regexp_replace("text", f"^[{tx.WS}]+|[{tx.WS}]+$", "")
    squeezed = F.trim(F.regexp_replace("text", f"[{tx.WS}]+", " "))
    c = F.col("text")
    for r in odd.select("text", tk.tokens(c), plain, tx.fold(c), folded, tx.strip(c), stripped, tx.squeeze(c), squeezed).collect():
        assert r[1] == r[2] and r[3] == r[4] and r[5] == r[6] and r[7] == r[8], r


def test_phrases_and_frequencies_without_documents(spark):
    docs = kw.add_tokens(spark.createDataFrame([("d", i % 3, "alpha beta gamma delta" + " word" * (i % 4) + f" rare{i}x") for i in range(40)], "domain string, doc long, text string"))
    scores = sorted((r["keyword"], r["total_frequency"]) for r in kw.keyword_scores(docs, ["domain"], "doc").collect())
    assert scores == sorted((r["keyword"], r["total_frequency"]) for r in kw.keyword_frequencies(docs, ["domain"]).collect()) and scores
    stats = kw.gram_stats(docs, ["domain"], "doc")
    pairs = kw.bigram_pmi(stats, kw.totals(docs, ["domain"]), ["domain"])
    same = lambda df: sorted((r["gram"], r["n"], round(r["pmi"], 9)) for r in df.collect())
    assert same(kw.phrase_pmi(docs, ["domain"], 2)) == same(pairs) and pairs.count() > 2
    assert same(kw.phrase_pmi(docs, ["domain"], 3)) == same(kw.trigram_pmi(stats, pairs, ["domain"]))


def test_details_build_only_grams_that_begin_like_a_chosen_one(spark):
    docs = kw.add_tokens(spark.createDataFrame([("d", 1, "alpha_one beta gamma alpha beta"), ("d", 2, "gamma alpha_one beta alpha"), (None, 3, "alpha beta")],
                                               "domain string, doc long, text string"))
    chosen = spark.createDataFrame([("d", "alpha one beta"), ("d", "gamma")], "domain string, keyword string")
    grams = kw.candidate_grams(docs, ["domain"], "doc", chosen.withColumnRenamed("keyword", "gram"))
    assert {r["gram"].split()[0] for r in grams.collect()} == {"alpha_one", "alpha", "gamma"}
    got = kw.keyword_details(docs, chosen, ["domain"], "doc").collect()
    assert sorted((r["keyword"], r["doc"], r["n"]) for r in got) == [("alpha one beta", 1, 1), ("alpha one beta", 2, 1), ("gamma", 1, 1), ("gamma", 2, 1)]


def test_single_spaces_and_plain_letters_meet_no_slow_regex(odd):
    plan = odd.select(tk.tokens(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z ") >= 1 and "&&[^ ]]+" in plan and "octet_length" not in plan
    shown = odd.select(tk.shown(F.col("text")).alias("s"), F.translate("text", "_", " ").alias("t")).collect()
    assert all(r["s"] == r["t"] for r in shown)
    for word in ["abc", "zoo", "éab", "{ab", "a12", "123", "1b2", "½½½", "---", "httpx", "wwwx", "ab", None]:
        ok = odd.limit(1).select(tk.valid_token(F.lit(word))).first()[0]
        want = None if word is None else len(word) > 2 and not word.startswith(("http", "www")) and (any(x.isalpha() for x in word) or "½" in word)
        assert ok == want, word


def test_scored_queries_are_those_of_every_twentieth_conversation(spark, tmp_path):
    spark.range(100).select(F.expr("id div 2 as conv_id"), F.expr("id % 2 as turn"), F.lit("user").alias("role"), F.lit("a b").alias("text")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(r["query_id"] for r in search_queries.asked(spark, str(tmp_path)).collect())
    assert got == sorted(c * 1_000_000 + t for c in (0, 20, 40) for t in (0, 1))


def test_records_of_many_conversations_share_a_file(spark, tmp_path, monkeypatch):
    rows = [(c, t) for c in range(1200) for t in range(2)] + [(7, 1), (None, 0), (3, None), (None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(serving_queries, "run_dir", lambda spark, name: f"{tmp_path}/{name}")
    got = [tuple(r) for r in serving_queries.s4_read_records(spark, str(tmp_path)).collect()]
    order = lambda rs: sorted(rs, key=str)
    assert order(got) == order(rows)
    files = [f for _, _, names in os.walk(f"{tmp_path}/records") for f in names if f.endswith(".txt")]
    assert len(files) <= 8
