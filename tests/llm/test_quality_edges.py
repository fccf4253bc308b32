"""op7 over texts without words beside others of their language."""

from canopy.llm import perplexity


def test_texts_without_words_divide_by_nothing(spark):
    words = lambda i: " ".join(f"{a}{b}{i}" for a in "abcdefgh" for b in "klmnopqr")
    rows = [(i, words(i), "en") for i in range(6)] + [(10, "", "en"), (11, None, "en"), (12, " \t\n", "en"), (13, "", "xx"), (None, "", None)]
    got = perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), ["doc_id"]).collect()
    assert len(got) == len(rows)
    empty = [x for x in got if x["doc_id"] is None or x["doc_id"] >= 10]
    assert all((x["n_words"], x["base_failed"], x["kept"], x["log_perplexity"]) == (0, True, False, None) for x in empty) and len(empty) == 5
    assert sum(x["kept"] for x in got) == 6
