"""The near-dedup stage against brute-force Jaccard similarities of five-word shingles."""

import random

import pytest

import corpus_pipeline as cp
from canopy.llm import shingles
from tests.llm.test_pairs import groups


def five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def linked(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("light", [2, 32])
def test_near_dedup_is_jaccard_of_five_words(spark, monkeypatch, light):
    monkeypatch.setattr(shingles, "LIGHT", light)
    monkeypatch.setattr(shingles, "LEADERS", 1 if light == 2 else 4)
    r = random.Random(light)
    word = lambda: r.choice("abcdefgh") + str(r.randint(0, 400))
    common = [word() for _ in range(30)]
    texts = [None, "", " \t", "One two", "ONE  two", "é É", "a b c d e", "a b c d e f"]
    for _ in range(5):
        w = [word() for _ in range(r.choice([40, 120, 300]))]
        for _ in range(24):  # chains: each text is an edit of an earlier one
            if r.random() < 0.5:
                w = list(w)
            for _ in range(r.randint(0, len(w) // 40)):
                w[r.randrange(len(w))] = word()
            texts.append(r.choice([" ", "\n"]).join(w))
    texts += [" ".join(common + [word() for _ in range(r.choice([5, 30, 100]))]) for _ in range(50)]
    sets = [five(t) for t in texts]
    heads = set(groups(len(texts), lambda i, j: linked(sets[i], sets[j])))
    assert 60 < len(heads) < len(texts) - 40
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    kept = cp.near_dedup(spark, docs, "").collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(heads)
    assert all(x["text"] == texts[x["doc_id"]] and x["node"] == "x" for x in kept)


def test_near_dedup_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((x["doc_id"], x["text"]) for x in docs.collect())
    sets = [five(t) for _, t in rows]
    close = lambda i, j: 4 * max(len(sets[i]), len(sets[j])) <= 5 * min(len(sets[i]), len(sets[j])) and linked(sets[i], sets[j])
    heads = set(groups(len(rows), close))
    assert sorted(x["doc_id"] for x in cp.near_dedup(spark, docs, "").collect()) == sorted(rows[h][0] for h in heads)


def test_near_dedup_of_repeated_ids(spark):
    odd = [(None, "x y z w"), (None, "x y z w"), (5, "p q r s"), (5, "p q r s"), (5, "other words are here"), (3, "p q r s"), (None, "alone")]
    got = cp.near_dedup(spark, spark.createDataFrame(odd, "doc_id long, text string"), "").collect()
    assert sorted((x["doc_id"] or 0, x["text"]) for x in got) == [(0, "alone"), (0, "x y z w"), (3, "p q r s"), (5, "other words are here")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert cp.near_dedup(spark, none, "").count() == 0


def test_simhash_groups_come_first(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{r.randint(0, 9999)}" for _ in range(900)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(f"v{r.randint(0, 9999)}" for _ in range(900))]
    called, operator = [], shingles.near_duplicates
    monkeypatch.setattr(shingles, "near_duplicates", lambda *a: called.append(a) or operator(*a))
    found = []
    check = shingles._verified
    monkeypatch.setattr(shingles, "_verified", lambda pairs, *a: found.append(pairs.distinct().count()) or check(pairs, *a))
    monkeypatch.setattr(shingles, "_pairs", lambda left, right, extra: left.select("node", "node").toDF("a", "b").limit(0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # Without the prefix filter, the index alone names the pair of near copies.
    assert sorted(x["doc_id"] for x in cp.near_dedup(spark, docs, "").collect()) == [0, 2] and len(called) == 1 and found[0] == 1
