"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from canopy.llm import ngram_join
from tests.llm.test_pairs import groups


def five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def test_tree_finds_what_a_loop_finds():
    r = random.Random(3)
    base = sorted(r.sample(range(1, 4000), 60))
    sets = []
    for _ in range(120):
        s = set(base) if r.random() < 0.6 else set(r.sample(range(1, 4000), 60))
        for _ in range(r.randint(0, 12)):
            s.discard(r.choice(base))
            s.add(r.randint(1, 4000))
        sets.append(np.array(sorted(s), np.uint64))
    prefix = [s[: len(s) - (len(s) * 4 + 4) // 5 + 1] for s in sets]
    tree = ngram_join.PrefixTree(prefix, np.array([len(s) for s in sets]))
    similar = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    total = emitted = 0
    for i, s in enumerate(sets):
        allowed = np.ones(len(sets), bool)
        got = {tree.order[j] for j in tree.probe(prefix[i], len(s), allowed)}
        emitted += len(got)
        want = {j for j, t in enumerate(sets) if similar(s, t)}
        total += len(want)
        assert want <= got and i in got
    assert total > 300 and emitted < 120 * 120 / 2
    blocked = np.ones(len(sets), bool)
    blocked[:60] = False
    assert min(tree.probe(prefix[0], len(sets[0]), blocked), default=60) >= 60


@pytest.mark.parametrize("light,block", [(2, 3), (32, 1024)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, light, block):
    for name, v in (("LIGHT", light), ("BLOCK", block), ("LEADERS", 1 if light == 2 else 4), ("CHUNK", 2 if light == 2 else 512)):
        monkeypatch.setattr(ngram_join, name, v)
    r = random.Random(light)
    word = lambda: r.choice("abcdefgh") + str(r.randint(0, 400))
    common = [word() for _ in range(30)]
    texts = [None, "", " \t", "One two", "ONE  two", "é É", "a b c d e", "a b c d e f"]
    for _ in range(3 if light == 2 else 5):
        w = [word() for _ in range(r.choice([40, 120, 300]))]
        for _ in range(24):  # chains: each text is an edit of an earlier one
            if r.random() < 0.5:
                w = list(w)
            for _ in range(r.randint(0, len(w) // 40)):
                w[r.randrange(len(w))] = word()
            texts.append(r.choice([" ", "\n"]).join(w))
    texts += [" ".join(common + [word() for _ in range(r.choice([5, 30, 100]))]) for _ in range(50)]
    texts += [" ".join(word() for _ in range(20_000))] * 2
    sets = [five(t) for t in texts]
    want = groups(len(texts), lambda i, j: linked(sets[i], sets[j]))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, node string, n int").repartition(4)
    got = {x["doc_id"]: x for x in ngram_join.near_groups(docs).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert len(set(want)) < len(texts) - 40


def test_groups_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((x["doc_id"], x["text"]) for x in docs.collect())
    sets = [five(t) for _, t in rows]
    close = lambda i, j: 4 * max(len(sets[i]), len(sets[j])) <= 5 * min(len(sets[i]), len(sets[j])) and linked(sets[i], sets[j])
    want = groups(len(rows), close)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_groups(docs).collect()}
    assert got == {d: (len(s), rows[g][0]) for (d, _), s, g in zip(rows, sets, want)}


def test_repeated_rows_and_null_ids(spark):
    odd = [(None, "x y z w"), (None, "x y z w"), (5, "p q r s"), (5, "p q r s"), (5, "other words are here"), (3, "P q r s"), (None, None), (9, None), (None, "p q  r s")]
    got = ngram_join.near_groups(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert sorted(tuple(-1 if v is None else v for v in x) for x in got) == sorted(
        [(-1, 1, -1)] * 2 + [(5, 1, 3)] * 2 + [(5, 1, 5), (3, 1, 3), (-1, 0, -1), (9, 0, 9), (-1, 1, 3)])
    assert ngram_join.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_closest_rows():
    a, b = np.array([1, 1, 1, 2, 2, 3]), np.array([5, 5, 6, 5, 5, 5])
    assert ngram_join._closest([(a,)], 2).tolist() == [0, 1, 3, 4, 5]
    assert ngram_join._closest([(a,), (b,)], 2).tolist() == [0, 1]
    assert ngram_join._closest([(a,), (a, b)], 1).tolist() == [0, 3, 5]
