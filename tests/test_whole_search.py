"""Search asks with every user turn, not with those of some conversations."""

import __spark_entry__ as entry
import pytest

from canopy.plans import search_queries as q


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search"))
    docs = [(i, f"Alpha{i} beta{i} gamma. More about alpha{i} and delta{i}.", "en", "src", 50) for i in range(30)]
    said = [(c, t, ("user", "assistant")[t % 2], f"alpha{c} beta{c} gamma") for c in range(1, 30) for t in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


EVERY = {c * 1_000_000 + t for c in range(1, 30) for t in (0, 2)}


@pytest.mark.parametrize("name", ["t24_scores", "k13_matches", "t16_routes"])
def test_all_user_turns_ask(spark, sf, name):
    assert {r["query_id"] for r in entry.queries()[name](spark, sf).collect()} == EVERY
    assert "% 20" not in entry.oracle_sql().get(name, "")


def test_every_pair_that_shares_a_term_is_scored(spark, sf):
    got = q.t24_scores(spark, sf).collect()
    assert len(got) == len({(r["query_id"], r["event_id"]) for r in got}) == len(EVERY) * 30   # all hold the word gamma
