import json
import random

import numpy as np
from pyspark.sql import functions as F

from canopy.operators import graph, ordering, requests, tree
from canopy.session import cut


def walk_in_order(rows):
    """Brute force: roots first, then what is left in source order; depth first."""
    first = {}
    for seq, cid, pid in sorted(rows):
        first.setdefault(cid, (seq, pid))
    kids, roots = {}, []
    for cid, (seq, pid) in first.items():
        if pid in (None, "", "None") or pid not in first or pid == cid:
            roots.append((cid, pid not in (None, "", "None")))
        else:
            kids.setdefault(pid, []).append(cid)
    out = {}

    def go(root, orphan):
        stack = [(root, 1)]
        while stack:
            c, level = stack.pop()
            if c in out:
                continue
            out[c] = (root, level, orphan and level == 1)
            stack.extend((k, level + 1) for k in kids.get(c, []))
    for r, o in roots:
        go(r, o)
    for c in first:
        if c not in out:
            go(c, True)
    return out


def test_threads_match_a_walk_with_orphans_duplicates_and_cycles(spark):
    rng = random.Random(4)
    rows = []
    for seq in range(120):
        pid = rng.choice([None, "None", "gone", f"n{rng.randrange(100)}", f"n{rng.randrange(100)}", f"n{rng.randrange(100)}"])
        rows.append((seq, f"n{rng.randrange(100)}", pid))
    rows += [(1000 + i, f"deep{i}", f"deep{i - 1}" if i else None) for i in range(21)]  # deeper than the open rows are many
    df = spark.createDataFrame([("e", c, p, s) for s, c, p in rows], "event_id string, comment_id string, parent_id string, seq long")
    got = {r["comment_id"]: (r["root_id"], r["level"], r["orphan"]) for r in tree.build_threads(df).collect()}
    assert got == walk_in_order(rows)


def test_nesting_in_chunks_and_back(spark):
    parents = {1: None, 2: 1, 3: 2, 4: 3, 5: 1, 6: None, 7: 6, 8: 4}
    df = spark.createDataFrame([("e", f"n{i}", f"n{p}" if p else None, i, f'text "{i}"\n') for i, p in parents.items()],
                               "event_id string, comment_id string, parent_id string, seq long, text string")
    threads = cut(tree.build_threads(df).drop("parent_id"))
    for chunk in (3, 100):
        parts = sorted((r["chunk"], r["json"]) for r in tree.nest(threads, chunk).collect())
        assert len(parts) == (3 if chunk == 3 else 1)
        doc = json.loads("".join(j for _, j in parts))
        ids = lambda ns: [(n["comment_id"], n["order"], n["reply_count"], ids(n["replies"])) for n in ns]
        assert ids(doc) == [("n1", 1, 2, [("n2", 1, 1, [("n3", 1, 1, [("n4", 1, 1, [("n8", 1, 0, [])])])]), ("n5", 2, 0, [])]), ("n6", 2, 1, [("n7", 1, 0, [])])]
    flat = tree.flatten_documents(spark.createDataFrame([("e", json.dumps(doc))], "id_content string, comments string"))
    order = [r["comment_id"] for r in flat.orderBy("path").collect()]
    assert order == ["n1", "n2", "n3", "n4", "n8", "n5", "n6", "n7"]
    assert {r["comment_id"]: r["level"] for r in flat.collect()}["n8"] == 5


def test_ordering_over_buckets_equals_plain_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, s long, v long")
    b = ordering.buckets("s", 7)
    num = {r["s"]: r["rn"] for r in ordering.number_rows(df, ["g"], ["s"], b).collect()}
    tot = {r["s"]: r["t"] for r in ordering.running_sum(df, ["g"], ["s"], b, F.coalesce("v", F.lit(0)), "t").collect()}
    prev = {r["s"]: r["p"] for r in ordering.last_before(df, ["g"], ["s"], b, F.col("v"), "p").collect()}
    for g in ("a", "b", None):
        n = t = 0
        last = None
        for _, s, v in [r for r in rows if r[0] == g]:
            n, t = n + 1, t + (v or 0)
            assert (num[s], tot[s], prev[s]) == (n, t, last)
            last = v if v is not None else last


def test_packing_in_spans_equals_the_greedy_loop(spark):
    rng = random.Random(9)
    sizes = [("e", f"r{i}", rng.choice([1, 1, 5, 20, 45, 60, 90]), rng.choice([0, 1, 2]), i) for i in range(150)] + [("f", "q", 3, 1, 0)]
    df = spark.createDataFrame(sizes, "event_id string, root_id string, size long, asked long, seq long")
    got = {(r["event_id"], r["root_id"]): r["batch"] for r in requests.pack_threads(df, 60, span=4).collect()}
    want, fill, batch = {("f", "q"): 1}, 0, 0
    for e, root, size, asked, _ in sizes:
        if e == "e" and asked:
            if batch == 0 or fill + size > 60:
                batch, fill = batch + 1, 0
            fill += size
            want[(e, root)] = batch
    assert got == want


def test_responses(spark):
    m = [("e", b, d, f"K1.{i}", f"{b}-{i}", i == 3) for b, d in enumerate(["showbiz", "education", "showbiz", "showbiz"]) for i in range(4)]
    members = spark.createDataFrame(m, "event_id string, batch long, domain string, local_id string, comment_id string, rule_trash boolean")
    answers = [
        ("e", 0, '<think>x</think>```json\n{"clusters":[{"cluster":"K1","summary":"line\nbreak","comments":[{"id":"K1.0","is_trash":false,"emotion":"ck","toxic":true,"toxic_type":"CB"},'
                 '{"id":"K1.1","is_trash":true},{"id":"K9.9","emotion":"CK"},{"id":"K1.3","emotion":"CK"}]}]}\n```'),
        ("e", 1, 'Here: {"clusters":[{"cluster":"K1","summary":"s","comments":[{"id":"K1.0","stance":"tích cực"},{"id":"K1.1","stance":"XX"},{"id":"K1.0","stance":"TI"}]}]} done'),
        ("e", 2, '{"clusters":[{"cluster":"K1","summary":"a "quoted" word","comments":[{"id":"K1.0","emotion":"UH"},{ "id": "K1.1","emotion":"PN"}'),
        ("e", 3, "no idea")]
    r = spark.createDataFrame(answers, "event_id string, batch long, response string")
    got = {x["comment_id"]: (x["is_trash"], x["label"], x["toxic"], x["toxic_type"], x["label_source"]) for x in requests.read_labels(r, members).collect()}
    assert got["0-0"] == (False, "Cà khịa", True, "chửi bới", "llm")
    assert got["0-1"] == (True, None, None, None, "llm")
    assert got["0-2"] == (False, "Trung lập", False, None, "fallback_missing")
    assert got["0-3"] == (True, None, None, None, "rule")
    assert got["1-0"] == (False, "tiêu cực", None, None, "llm")
    assert got["1-1"] == (False, "trung lập", None, None, "fallback_invalid_label")
    assert got["2-0"][1] == "Ủng hộ" and got["2-1"][1] == "Phẫn nộ" and got["2-2"][4] == "fallback_missing"
    q = {x["batch"]: (x["bad"], x["asked"], x["verdict"]) for x in requests.answer_quality(requests.read_labels(r, members)).collect()}
    assert q[3] == (3, 3, "fail") and q[2][2] == "warn" and q[0] == (1, 3, "warn")
    roots = members.filter("local_id = 'K1.0'").withColumn("n", F.lit(0)).withColumn("k", F.lit(1)).withColumn("root_id", F.col("comment_id"))
    s = {x["root_id"]: x["summary"] for x in requests.read_summaries(r, roots).collect()}
    assert s == {"0-0": "line\nbreak", "1-0": "s", "2-0": 'a "quoted" word'}


def test_encoder_equals_numpy(spark):
    rng = np.random.RandomState(0)
    x, dim, hidden = rng.randn(6, 5), 5, 3
    pairs = [(1, 0), (2, 0), (3, 1), (4, 1)]
    nodes = spark.createDataFrame([("e", f"n{i}", x[i].tolist()) for i in range(6)], "event_id string, comment_id string, x array<double>")
    edges = spark.createDataFrame([("e", f"n{a}", f"n{b}") for a, b in pairs], "event_id string, child string, parent string")
    layers = [{"l": rng.randn(hidden, d), "r": rng.randn(hidden, d), "b": rng.randn(hidden)} for d in (dim, hidden)]
    head = {"w": rng.randn(2, hidden), "b": rng.randn(2)}
    adj = np.zeros((6, 6))
    for a, b in pairs:
        adj[a, b] = adj[b, a] = 1
    h = x
    for la in layers:
        mean = adj @ h / np.maximum(adj.sum(1, keepdims=True), 1)
        h = np.maximum(mean @ la["l"].T + h @ la["r"].T + la["b"], 0)
    want = h @ head["w"].T + head["b"]
    got = {r["comment_id"]: r["logits"] for r in graph.encode(nodes, edges, layers, head).collect()}
    assert np.allclose([got[f"n{i}"] for i in range(6)], want)


def test_chunks_are_read_at_any_size(spark):
    rng = random.Random(4)
    rows = [("e", f"c{i}", f"c{rng.randrange(i)}" if i and rng.random() < 0.9 else None, i, rng.choice(['x ,"replies":[ ]}]} "q" \\', "plain\nline", None])) for i in range(60)]
    rows += [("f", f"d{i}", f"d{i - 1}" if i else None, i, "deep") for i in range(25)]
    threads = tree.build_threads(spark.createDataFrame(rows, "event_id string, comment_id string, parent_id string, seq long, text string"))
    want = {(r["event_id"], r["comment_id"]): (r["parent"], r["level"], r["text"] or "") for r in threads.collect()}
    for chunk in (10, 1000):
        flat = tree.flatten_chunks(tree.nest(threads, chunk)).collect()
        assert {(r["event_id"], r["comment_id"]): (r["parent_id"], r["level"], r["text"]) for r in flat} == want and len(flat) == 85


def test_request_steps_are_staged(spark, tmp_path):
    from canopy.plans import request_queries as q

    rows = [(c, t, "user", f"a sentence of turn {t} that says enough") for c in range(40) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    t, _, m = q.members(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # What several steps read is computed once: noise rules, packing and the walk are in no later plan.
    assert "Window" not in plan(t) and "Join" not in plan(t)
    assert "FlatMapGroupsInPandas" not in plan(m) and "Window" not in plan(m)
    parsed = requests.parse_responses(q.answers(m))
    assert "from_json" not in plan(parsed) and "jsontostructs" not in plan(parsed)
    assert m.count() == 200 and parsed.count() == m.select("event_id", "batch").distinct().count()
