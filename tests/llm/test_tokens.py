"""op1 and op10 against the tokenizers library itself."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from canopy.llm import bpe, token_counts
from canopy.llm.tokenizer import Pieces, tokenizer_source

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n", "a", "don't stop", "x  y\t\tz ", "<|endoftext|> a<|endoftext|>b", "é ̈ é ẞ İ Σας", "漢字かな 😀😀", "\xa0a b\x1cc", "a" * 3000,
       "Zwölf Boxkämpfer 1234!!", "it's we'll 'S 're", " lead", "trail \n"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijé'!0") for _ in range(r.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_worker_encodes_as_the_library(path):
    tok, r = Tokenizer.from_file(path), random.Random(3)
    texts = [*ODD, *(words(r, 200) for _ in range(50))]
    p = Pieces(tokenizer_source(path)[0])
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # without and with kept pre-tokens
        assert [x.tolist() for x in p.ids(texts)] == want
        assert p.count(texts) == [len(x) for x in want]
    assert p.decode([__import__("numpy").asarray(x, "int32") for x in want]) == [tok.decode(x, skip_special_tokens=False) for x in want]


def test_counts_with_cache(spark, tmp_path):
    tok = Tokenizer.from_file(BYTE)
    texts = [*ODD, None, "a", "a", "", None]
    df = docs(spark, texts).drop("n_tokens")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, cache, BYTE).collect()}
        assert got == {i: len(tok.encode(t or "").ids) for i, t in enumerate(texts)}
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})  # distinct contents, once
    other = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, cache, WORD).collect()}
    assert other == {i: len(Tokenizer.from_file(WORD).encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_stored_counts_are_used(spark, tmp_path):
    cache = str(tmp_path / "cache")
    df = docs(spark, ["one text"])
    digest = hashlib.sha256(b"one text").digest()
    spark.createDataFrame([(bytearray(digest), tokenizer_source(BYTE)[1], 77)] * 2, "digest binary, version string, n_tokens long").write.parquet(cache)
    assert token_counts.count_tokens(df, cache, BYTE).first()["n_tokens"] == 77


def test_empty_table(spark, tmp_path):
    none = docs(spark, [])
    assert token_counts.count_tokens(none, str(tmp_path / "c"), BYTE).count() == 0
    assert bpe.decode(bpe.encode(none, WORD), WORD).count() == 0


def test_tree_of_halves_is_exact():
    tok, r = Tokenizer.from_file(WORD), random.Random(1)
    p = Pieces(tokenizer_source(WORD)[0])
    letters = [*"abcdefghijklmnopqrstuvwxyzABC'''0123!?.,-éÉ漢字😀ß", "́", "̈", "'s", "'re", "<|endoftext|>", "thing", "ing", "tion", "İ"]
    for n in range(1500):
        t = "".join(r.choice(letters if n % 3 else ["a", "b", "the", "ing", "n", "t", "'"]) + (" " if n % 2 and r.random() < 0.05 else "") for _ in range(r.randint(0, 250)))
        parts = [bpe.encode_part(p, x) for x in bpe.cut_text(t, r.choice([8, 20, 60]), r.choice([1, 4]))]
        assert bpe.join_tree(p, parts).ids().tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_round_trip_of_short_and_long_texts(spark):
    tok, r = Tokenizer.from_file(WORD), random.Random(5)
    long = words(r, 400)
    texts = [*ODD, None, long, long, "x" * 900 + " " + "yé" * 700, *(words(r, 60) for _ in range(5))]
    coded = bpe.encode(docs(spark, texts).withColumnRenamed("n_tokens", "digest"), WORD, leaf=200)
    assert coded.columns == ["doc_id", "text", "digest", "ids"]
    got = {x["doc_id"]: (x["ids"], x["decoded"]) for x in bpe.decode(coded, WORD).collect()}
    both = bpe.encode(docs(spark, texts), WORD, leaf=200, decoded="decoded", keep=["doc_id"])
    assert both.columns == ["doc_id", "ids", "decoded"] and {x["doc_id"]: (x["ids"], x["decoded"]) for x in both.collect()} == got
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, tok.decode(ids, skip_special_tokens=False))


def test_ids_of_parts_travel_packed(spark):
    import numpy as np

    for ids in ([], [0, 65535], [65536, 1, 2**31 - 1]):
        packed = bpe._packed(np.array(ids, np.int32))
        assert bpe._unpacked(packed).tolist() == ids and len(packed) == 1 + len(ids) * (2 if max(ids, default=0) < 65536 else 4)
    docs = spark.createDataFrame([(1, "ab cd " * 9), (2, "ab cd " * 9), (3, None), (4, "x")], "doc_id long, text string")
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded", keep=["doc_id"], leaf=16)
    got = {x["doc_id"]: (x["ids"], x["decoded"]) for x in coded.collect()}
    assert got[1] == got[2] and len(got[1][0]) >= 18 and got[3] == ([], "")


def test_pieces_of_long_texts_are_dealt_once(spark):
    docs = spark.createDataFrame([(i, "ab cd " * 9) for i in range(3)], "doc_id long, text string")
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), leaf=16)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(digest#") == 2 and "REPARTITION_BY_COL" not in plan  # pieces, then parts
    assert len({tuple(x["ids"]) for x in coded.collect()}) == 1
