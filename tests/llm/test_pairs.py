"""op8, op3 and op9 against brute force."""

import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from canopy.llm import line_dedup, simhash, top_k
from canopy.llm.components import components


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    nodes = list(range(600))
    r.shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1]) for i in range(0, 400) if i != 200] + [(nodes[450], nodes[i]) for i in range(450, 560)] + [(7000, 7000)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges + edges[:5] + [(None, 3)], "a long, b long")).collect()}
    for part in (nodes[:201], nodes[201:401], nodes[450:560]):
        assert {got[x] for x in part} == {min(part)}
    assert 7000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("light", [2, 32])
def test_near_duplicates(spark, monkeypatch, light):
    monkeypatch.setattr(simhash, "LIGHT", light)
    r = random.Random(4)
    base = [[r.choice("abcdefgh") + str(r.randint(0, 40)) for _ in range(120)] for _ in range(4)]
    texts = [None, "", " \t", "One two", "ONE two", "é É"]
    for b in base:
        for _ in range(25):
            w = list(b)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = str(r.random())
            texts.append(r.choice([" ", "\n"]).join(w))
    ids = list(range(10, 10 + len(texts)))
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, fp int")
    prints = [fingerprint(t) for t in texts]
    want = groups(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = {x["doc_id"]: (x["fingerprint"] % 2**64, x["component_id"]) for x in simhash.near_duplicates(df).collect()}
    assert got == {i: (p, ids[c]) for i, p, c in zip(ids, prints, want)}
    assert sorted(x["doc_id"] for x in simhash.keep_one(df).collect()) == sorted({ids[c] for c in want})


def test_links_at_every_distance(spark):
    r = random.Random(8)
    fps = set()
    for _ in range(30):
        x = r.getrandbits(64)
        fps |= {x, x ^ (1 << r.randrange(64)), x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)), x ^ 0b111 << r.randrange(60)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(x["a"], x["b"]) for x in simhash.links(df).collect()}
    assert got == {(min(a, b), max(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and (fps[i] ^ fps[j]).bit_count() <= 2}


def test_near_duplicates_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "x y z w"), (None, "x y z w"), (5, "p q r s"), (5, "p q r s"), (5, "other words are here")], "doc_id long, text string")
    assert sorted((x["component_id"] is None, x["component_id"]) for x in simhash.near_duplicates(odd).collect()) == [(False, 5)] * 3 + [(True, None)] * 2
    assert simhash.keep_one(odd).count() == 2


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_lines(rows, least):
    """Removed line numbers by (doc_id, text)."""
    seen, out = [], defaultdict(list)
    lines = sorted((i, t, n, frozenset(x.lower().split())) for i, t in set(rows) if t is not None for n, x in enumerate(t.split("\n")))
    for i, t, n, s in lines:
        if len(s) >= least:
            if any(similar(s, o) for o in seen):
                out[i, t].append(n)
            seen.append(s)
    return out


@pytest.mark.parametrize("light,least", [(64, 4), (2, 4), (3, 1)])
def test_line_dedup(spark, monkeypatch, light, least):
    monkeypatch.setattr(line_dedup, "LIGHT", light)
    r = random.Random(light)
    vocab = [f"w{i}" for i in range(300)]
    pool = [[r.choice(vocab) for _ in range(r.choice([1, 2, 4, 5, 8, 12, 20]))] for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(pool)) if r.random() < 0.7 else [r.choice(vocab) for _ in range(10)]
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(vocab)
            r.shuffle(w)
            lines.append(r.choice([" ", "  ", "\t"]).join(w).upper() if r.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (3, rows[3][1])]
    want = brute_lines(rows, least)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, line string")
    got = line_dedup.dedup_lines(df, least).collect()
    assert len(got) == len(rows)
    for x in got:
        t = dict((i, t) for i, t in rows)[x["doc_id"]]
        gone = want.get((x["doc_id"], t), [])
        assert x["removed"] == gone
        assert x["text"] == (t if not gone else "\n".join(y for n, y in enumerate(t.split("\n")) if n not in gone))


def test_line_dedup_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e\nx"), (1, "e d c b a"), (1, "a b c d f g h"), (2, None)], "doc_id long, text string")
    got = {(x["doc_id"], tuple(x["removed"])) for x in line_dedup.dedup_lines(rows).collect()}
    assert got == {(None, ()), (1, (0,)), (1, ()), (2, ())}


def test_short_lines_go(spark):
    texts = ["All rights reserved.\nyes", "one\nreserved. All  rights\nyes yes", "漢字漢字漢字漢字。\nAll rights", "a\n漢字漢字漢字漢字。"]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["removed"] for x in got} == {0: [], 1: [1, 2], 2: [], 3: [1]}


def test_lines_that_differ_in_case_go(spark):
    texts = ["Please Subscribe To Our Newsletter\nÄrger é", "please subscribe to our newsletter", "ärger É\nPLEASE SUBSCRIBE TO OUR NEWSLETTER NOW"]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["removed"] for x in got} == {0: [], 1: [0], 2: [0, 1]}


def test_line_dedup_is_native(spark):
    df = spark.createDataFrame([(i, f"a b c d e{i % 3}\nq") for i in range(9)], "doc_id long, text string")
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def brute_top(rows, k, scale=256):
    from math import floor, isfinite

    fine = [(i, [floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % 3 == 0}):
        e = min(v for i, v in fine if i == q)
        found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(e, v)))), i) for i, v in fine if i != q and len(v) == len(e))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("block", [2, 4096])
def test_exact_top_k(spark, block):
    r = random.Random(block)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, [0.5] * 6) for i in range(40)]  # ties
    rows += [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (204, [float("nan")] * 6), (207, [float("inf")] * 6), (300, [1.0, 2.0]), (303, [2.0, 1.0]), (None, [1.0] * 6), (306, []), (309, [])]
    rows += [(7, rows[7][1]), (9, rows[9][1])]  # repeated rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in top_k.exact_top_k(df, F.col("vec_id") % 3 == 0, k=5, block=block).collect())
    assert got == sorted(brute_top(rows, 5))


def test_exact_top_k_of_large_numbers_and_nothing(spark):
    rows = [(i, [1e9 * (i - 4), 3e8, float(i)]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in top_k.exact_top_k(df, F.col("vec_id") % 3 == 0, k=3).collect()) == sorted(brute_top(rows, 3))
    assert top_k.exact_top_k(df.limit(0), F.col("vec_id") % 3 == 0).count() == 0


def test_only_lines_of_close_sketches_are_read(spark, monkeypatch):
    r = random.Random(12)
    word = lambda: f"w{r.randint(0, 700)}"
    lines = [" ".join(dict.fromkeys(word() for _ in range(170))) for _ in range(60)]
    lines += [x.replace(" w", " v", 3) for x in lines[:4]]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    kept, write = {}, line_dedup.cut

    def keep(df, name):
        out = write(df, name)
        kept.setdefault(name, out)
        return out

    monkeypatch.setattr(line_dedup, "cut", keep)
    monkeypatch.setattr(line_dedup, "discard", lambda *tables: None)
    got = {x["doc_id"] for x in line_dedup.removed_lines(docs).collect()}
    want = {d for d, _ in brute_lines(list(enumerate(lines)), 1)}
    assert got == want == {60, 61, 62, 63}
    # One sketch cannot tell such long lines apart, four can: their texts move for pairs that may be similar alone.
    assert kept["candidates"].count() > 4 and kept["texts"].count() <= 2 * kept["few"].count() == 8


def test_long_lines_meet_by_two_sketches(spark, monkeypatch):
    r = random.Random(13)
    word = lambda: f"w{r.randint(0, 700)}"
    lines = [" ".join(dict.fromkeys(word() for _ in range(n))) for n in (170, 90, 60) for _ in range(50)]
    lines += [x.replace(" w", " v", 3) for x in (lines[0], lines[50], lines[100])]
    lines += [" ".join(x.split()[:80]) for x in lines[50:100]]   # of one sketch, beside lines of two
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    kept, write = {}, line_dedup.cut

    def keep(df, name):
        out = write(df, name)
        kept.setdefault(name, out)
        return out

    monkeypatch.setattr(line_dedup, "cut", keep)
    monkeypatch.setattr(line_dedup, "discard", lambda *tables: None)
    got = {x["doc_id"] for x in line_dedup.removed_lines(docs).collect()}
    want = {d for d, _ in brute_lines(list(enumerate(lines)), 1)}
    assert got == want and {150, 151, 152} <= got
    # Pairs of long lines that are not similar do not even become candidates.
    similar_pairs = kept["few"].count()
    assert kept["candidates"].distinct().count() <= similar_pairs + 3
