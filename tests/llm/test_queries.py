"""The registered queries without SQL against plain loops over the small tables."""

import hashlib
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from canopy.llm import queries as q
from tests.llm.test_pairs import fingerprint, groups

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, table, *columns):
    return sorted(tuple(r) for r in q.read(spark, SF, table).select(*columns).collect())


def got(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_op1_counts_of_the_library(spark):
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tok.no_truncation(), tok.no_padding()
    found = got(q.op1(spark, SF))
    for i, t in rows(spark, "documents", "doc_id", "text"):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert found[i] == {"doc_id": i, "n_bytes": len((t or "").encode()), "n_tokens": n, "over_limit": n > 512}


def test_op10_ids_and_texts_of_the_library(spark):
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tok.no_truncation(), tok.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = got(q.op10(spark, SF))
    for i, t in rows(spark, "documents", "doc_id", "text"):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert found[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha(" ".join(map(str, ids))), "decoded_sha256": sha(tok.decode(ids, skip_special_tokens=False))}


def test_op7_base_figures(spark):
    found = got(q.op7(spark, SF))
    for i, t in rows(spark, "documents", "doc_id", "text"):
        words, t = WORD.findall(t or ""), t or ""
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = {}
        for j in range(len(words) - 2):
            windows.setdefault(tuple(words[j : j + 3]), []).append(j)
        repeated = {j + k for at in windows.values() if len(at) > 1 for j in at for k in range(3)}
        want = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)),
                "n_repeat_words": len(repeated), "base_failed": len(words) < 50 or 100 * len(repeated) > 50 * len(words)}
        assert {k: found[i][k] for k in want} == want
        assert not (found[i]["kept"] and found[i]["base_failed"])


def test_op8_fingerprints_and_groups(spark):
    docs = rows(spark, "documents", "doc_id", "text")
    prints = [fingerprint(t) for _, t in docs]
    want = groups(len(docs), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2)
    found = got(q.op8(spark, SF))
    assert found == {i: {"doc_id": i, "fingerprint": f"{p:016x}", "component_id": docs[g][0]} for (i, _), p, g in zip(docs, prints, want)}


def test_op12_whitened_rows(spark):
    found = q.op12(spark, SF).toPandas()
    vectors = rows(spark, "embeddings", "vec_id", "embedding")
    x = np.array([np.floor(1024 * np.array(v)) + 100_000 for _, v in vectors])
    assert len(found) == 8 * len(vectors) and found["n"].unique().tolist() == [len(vectors)]
    v = np.cov(x.T, bias=True)
    e, axes = np.linalg.eigh(v)
    for k in range(1, 9):
        part = found[found["component"] == k].sort_values("vec_id")
        want = (x - x.mean(axis=0)) @ axes[:, -k] / np.sqrt(e[-k])
        assert min(np.abs(part["whitened"] - want).max(), np.abs(part["whitened"] + want).max()) < 1e-6
        assert np.allclose(part["explained"], e[-k] / np.trace(v), rtol=1e-9) and part["identity_error"].max() < 1e-9
