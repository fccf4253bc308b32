"""The Merkle manifest against a plain loop; every proof leads to the root, no changed row does."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from canopy.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """(root, for every leaf its steps [(left, right)])."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // fanout * fanout : p // fanout * fanout + fanout]
            steps[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        at = [p // fanout for p in at]
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], steps


def brute(rows, fanout):
    """Sorted (id, leaf, subroot, root, steps) of rows (id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = [climb([x[2] for x in sorted(trees[s])], fanout) for s in order]
    root, outer = climb([b[0] for b in built], fanout)
    return sorted((x[1] if x[0] else None, x[2], b[0], root, st + up) if x[0] else (-1, x[2], b[0], root, st + up)
                  for s, b, up in zip(order, built, outer) for x, st in zip(sorted(trees[s]), b[1]))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("fanout,n", [(16, 700), (3, 60), (2, 40)])
def test_manifest_is_the_plain_tree(spark, fanout, n):
    r = random.Random(fanout)
    rows = [(i, r.choice(["hot"] * 6 + ["a", "Z", "é", "日本", "", None]), r.choice(["en", None]), r.choice([1, None]),
             r.choice([None, "", "Text Ä", "x" * 50_000, f"t{i}"])) for i in range(n)]
    rows += [(None, "a", "en", 1, "no id"), (None, None, None, None, None), (7, "hot", "en", 1, "again"), (7, "hot", "en", 1, "again"), (10**12, "one leaf", "en", 3, "abc")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("path", F.lit("p")).withColumn("tree", F.lit("t")).repartition(5)
    got = merkle.manifest(docs, FIELDS, "source", "doc_id", {"other": F.col("path")}, fanout).collect()
    plain = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["leaf"], x["subroot"], x["root"], [(s["left"], s["right"]) for s in x["path"]]) for x in got)
    assert plain == brute(rows, fanout)
    assert {x["other"] for x in got} == {"p"}


def test_proofs_lead_to_the_root(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    proven = merkle.manifest(docs, FIELDS, "source", "doc_id", {"seen": merkle.leaf_digest(*[F.col(c) for c in FIELDS[:-1]], F.concat("text", F.lit(".")))})
    ok, bad = (merkle.fold(F.col(c), F.col("path")) == F.col("root") for c in ("leaf", "seen"))
    assert proven.agg(F.bool_and(ok), F.bool_or(bad), F.countDistinct("root"), F.count("*")).first() == (True, False, 1, docs.count())


def test_small_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), FIELDS, "source", "doc_id").collect() == []
    (one,) = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), FIELDS, "source", "doc_id").collect()
    assert one["leaf"] == one["subroot"] == one["root"] == sha("1:1----") and one["path"] == []
