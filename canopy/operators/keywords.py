"""Keyword mining: n-gram counts, pointwise mutual information, scored keywords.

Everything stays in grouped counts. A word whose position is covered by a matched phrase is by definition a
word of that phrase, so suppressing phrase words already covers that case and no token position is needed
after the n-grams are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import tokens as tk
from canopy.session import cut

MIN_COUNT = 3
MIN_PMI = 1.0


def add_tokens(df: DataFrame, text: str = "text", strip_names: bool = False, segmenter=None) -> DataFrame:
    """Token column. segmenter(list of texts) -> list of token lists runs once per Arrow batch instead of
    the built-in white-space words."""
    source = tk.drop_name_tag(F.col(text)) if strip_names else F.col(text)
    if segmenter is None:
        return df.withColumn("tokens", tk.tokens(source))

    def segment(batches):
        for batch in batches:
            batch["tokens"] = segmenter(batch["_segment"].fillna("").tolist())
            yield batch.drop(columns="_segment")

    staged = df.withColumn("_segment", source)
    schema = df.withColumn("tokens", F.array().cast("array<string>")).schema
    return staged.mapInPandas(segment, schema)


def unigram_counts(docs: DataFrame, keys: list[str]) -> DataFrame:
    words = tk.each(docs, *keys, of="tokens", name="word")
    return words.groupBy(*keys, tk.shown(F.col("word")).alias("word")).agg(F.count("*").alias("n"))


def ngram_counts(docs: DataFrame, keys: list[str], n: int) -> DataFrame:
    shifted = [F.slice("tokens", F.lit(i + 1), F.greatest(F.size("tokens") - i, F.lit(0))).alias(f"w{i}") for i in range(n)]
    rows = tk.each(docs, *keys, of=F.arrays_zip(*shifted), name="run").filter(F.col(f"run.w{n - 1}").isNotNull())
    runs = rows.select(*keys, F.concat_ws(" ", *[f"run.w{i}" for i in range(n)]).alias("gram"))
    return runs.groupBy(*keys, tk.shown(F.col("gram")).alias("gram")).agg(F.count("*").alias("n"))


def totals(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens and bigrams per key, from the array sizes alone."""
    size = F.size("tokens").cast("long")
    return docs.groupBy(*keys).agg(
        F.count("*").alias("n_docs"),
        F.sum(size).alias("n_words"),
        F.sum(F.greatest(size - 1, F.lit(0).cast("long"))).alias("n_pairs"),
    )


def first_word(shown: Column) -> Column:
    return F.substring_index(shown, " ", 1)


def candidate_grams(docs: DataFrame, keys: list[str], doc: str, chosen: DataFrame | None = None) -> DataFrame:
    """One row per 1-, 2- and 3-gram made of valid tokens only: other grams can neither reach the PMI stage
    nor the keyword list. Validity is tested on exploded scalar columns, inside generated code. chosen (keys, gram as
    shown): only grams that begin with the first word of one of these are built."""
    toks = F.col("tokens")
    rows = tk.each(docs, *keys, doc, of=F.arrays_zip(
        toks.alias("a"),
        F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))).alias("b"),
        F.slice(toks, F.lit(3), F.greatest(F.size(toks) - 2, F.lit(0))).alias("c"),
    ), name="t").select(*keys, doc, "t.a", "t.b", "t.c")
    ok = lambda c: F.coalesce(tk.valid_token(F.col(c)), F.lit(False))
    if chosen is not None:
        starts = chosen.select(*keys, first_word(F.col("gram")).alias("_start")).distinct()
        rows = rows.withColumn("_start", first_word(tk.shown(F.col("a")))).join(F.broadcast(starts), [*keys, "_start"], "left_semi")
    rows = rows.select(*keys, doc, "a", "b", "c", ok("a").alias("va"), ok("b").alias("vb"), ok("c").alias("vc"))
    rows = rows.filter("va")
    two, three = F.col("vb"), F.col("vb") & F.col("vc")
    sep = F.lit(" ")
    gram = F.array(
        F.struct(F.lit(1).alias("size"), F.col("a").alias("gram")),
        F.when(two, F.struct(F.lit(2).alias("size"), F.concat("a", sep, "b").alias("gram"))),
        F.when(three, F.struct(F.lit(3).alias("size"), F.concat("a", sep, "b", sep, "c").alias("gram"))),
    )
    return tk.each(rows, *keys, doc, of=gram, name="g").select(*keys, doc, "g.size", "g.gram")


def gram_stats(docs: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """Occurrences and distinct documents per gram; both steps combine on the map side."""
    per_doc = candidate_grams(docs, keys, doc).groupBy(*keys, "size", "gram", doc).agg(F.count("*").alias("n"))
    return per_doc.groupBy(*keys, "size", "gram").agg(F.sum("n").alias("n"), F.count("*").alias("articles"))


def bigram_pmi(stats: DataFrame, total: DataFrame, keys: list[str], min_count: int = MIN_COUNT,
               min_pmi: float = MIN_PMI) -> DataFrame:
    """log2(p(ab) / (p(a) p(b))) of frequent bigrams at or above min_pmi."""
    uni = stats.filter("size = 1").select(*keys, F.col("gram").alias("word"), F.col("n").alias("m"))
    left = uni.select(*keys, F.col("word").alias("w1"), F.col("m").alias("n1"))
    right = uni.select(*keys, F.col("word").alias("w2"), F.col("m").alias("n2"))
    bi = stats.filter((F.col("size") == 2) & (F.col("n") >= min_count)).select(
        *keys, "gram", "n", "articles",
        F.split("gram", " ")[0].alias("w1"), F.split("gram", " ")[1].alias("w2"))
    joined = bi.join(left, [*keys, "w1"]).join(right, [*keys, "w2"]).join(total, keys)
    p12 = F.col("n") / F.col("n_pairs")
    p1, p2 = F.col("n1") / F.col("n_words"), F.col("n2") / F.col("n_words")
    scored = joined.withColumn("pmi", F.log2(p12 / (p1 * p2))).filter(F.col("pmi") >= min_pmi)
    return scored.select(*keys, "gram", "w1", "w2", "n", "articles", "pmi")


def trigram_pmi(stats: DataFrame, pairs: DataFrame, keys: list[str], min_count: int = MIN_COUNT) -> DataFrame:
    """Frequent trigrams whose two inner bigrams both score; their score is the mean."""
    tri = stats.filter((F.col("size") == 3) & (F.col("n") >= min_count))
    part = F.split("gram", " ")
    tri = tri.select(*keys, "gram", "n", "articles", F.concat_ws(" ", part[0], part[1]).alias("g1"),
                     F.concat_ws(" ", part[1], part[2]).alias("g2"))
    head = pairs.select(*keys, F.col("gram").alias("g1"), F.col("pmi").alias("pmi1"))
    tail = pairs.select(*keys, F.col("gram").alias("g2"), F.col("pmi").alias("pmi2"))
    return tri.join(head, [*keys, "g1"]).join(tail, [*keys, "g2"]).select(
        *keys, "gram", "n", "articles", ((F.col("pmi1") + F.col("pmi2")) / 2).alias("pmi"))


def keyword_counts(docs: DataFrame, keys: list[str], longest: int = 3) -> DataFrame:
    """gram_stats without the document counts: one shuffle of distinct grams instead of gram-document pairs."""
    rows = candidate_grams(docs.withColumn("_doc", F.lit(0)), keys, "_doc").filter(F.col("size") <= longest)
    return rows.groupBy(*keys, "size", "gram").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("articles"))


def best_keywords(docs: DataFrame, keys: list[str], doc: str, n: int = 10, digits: int = 6, **limits) -> dict[str, DataFrame]:
    """{top, details}: the n best keywords per key and their occurrences per document. Documents are counted only
    for the chosen keywords, in a second pass over the tokens."""
    docs = cut(docs.select(*keys, doc, "tokens"), "tokens")
    scored = _scores(keyword_counts(docs, keys), docs, keys, **limits).withColumn("score", F.round("score", digits))
    top = cut(top_keywords(scored, keys, n).drop("total_articles"), "top")
    details = cut(keyword_details(docs, top, keys, doc), "details")
    articles = details.groupBy(*keys, "keyword").agg(F.count("*").alias("total_articles"))
    return {"top": top.join(articles, [*keys, "keyword"]), "details": details}


def keyword_scores(docs: DataFrame, keys: list[str], doc: str, min_count: int = MIN_COUNT,
                   min_pmi: float = MIN_PMI) -> DataFrame:
    """Every scored keyword: phrases with their PMI, and the valid words of no phrase with PMI 0."""
    return _scores(gram_stats(docs, keys, doc), docs, keys, min_count, min_pmi)


def keyword_frequencies(docs: DataFrame, keys: list[str], min_count: int = MIN_COUNT, min_pmi: float = MIN_PMI) -> DataFrame:
    """keyword_scores where nobody asks for the documents: total_articles is null, and grams are not shuffled once per document."""
    docs = cut(docs.select(*keys, "tokens"), "tokens")
    return _scores(keyword_counts(docs, keys), docs, keys, min_count, min_pmi)


def phrase_pmi(docs: DataFrame, keys: list[str], longest: int, min_count: int = MIN_COUNT, min_pmi: float = MIN_PMI) -> DataFrame:
    """Scored bigrams (longest 2) or trigrams (longest 3) alone; rare phrases, which are most, are not kept."""
    docs = cut(docs.select(*keys, "tokens"), "tokens")
    stats = keyword_counts(docs, keys, longest)
    stats = cut(stats.filter((F.col("size") == 1) | (F.col("n") >= min_count)), "grams")
    pairs = bigram_pmi(stats, totals(docs, keys), keys, min_count, min_pmi)
    return pairs if longest == 2 else trigram_pmi(stats, cut(pairs, "pairs"), keys, min_count)


def _scores(stats: DataFrame, docs: DataFrame, keys: list[str], min_count: int = MIN_COUNT, min_pmi: float = MIN_PMI) -> DataFrame:
    # Rare phrases can be no keyword; only words are needed at any count.
    stats = cut(stats.filter((F.col("size") == 1) | (F.col("n") >= min_count)), "grams")
    total = cut(totals(docs, keys), "totals")
    pairs = cut(bigram_pmi(stats, total, keys, min_count, min_pmi), "pairs")
    triples = trigram_pmi(stats, pairs, keys, min_count)
    phrases = pairs.select(*keys, F.lit("bigram").alias("ngram_type"), "gram", "n", "articles", "pmi").unionByName(
        triples.select(*keys, F.lit("trigram").alias("ngram_type"), "gram", "n", "articles", "pmi"))
    # Both inner bigrams of a kept trigram are kept too, so the bigrams name every phrase word.
    used = pairs.select(*keys, F.explode(F.array("w1", "w2")).alias("gram")).distinct()
    words = stats.filter("size = 1").join(used, [*keys, "gram"], "left_anti").select(
        *keys, F.lit("unigram").alias("ngram_type"), "gram", "n", "articles", F.lit(0.0).alias("pmi"))
    return phrases.unionByName(words).select(
        *keys, tk.shown(F.col("gram")).alias("keyword"), "ngram_type",
        F.col("n").alias("total_frequency"), F.col("articles").alias("total_articles"), "pmi",
        score(F.col("n"), F.col("pmi")).alias("score"))


def score(freq: Column, pmi: Column) -> Column:
    return freq * F.log2(1 + F.greatest(pmi, F.lit(0.0)))


def top_keywords(scores: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    from canopy.operators.ordering import top_rows

    order = [F.col("score").desc(), F.col("total_frequency").desc(), F.col("keyword")]
    return top_rows(scores, keys, order, n, "rank")


def keyword_details(docs: DataFrame, chosen: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """Occurrences per document of the chosen keywords, as rows rather than one map per keyword: a map
    would hold an entry for every document. chosen is a top-n list, small by construction."""
    wanted = chosen.select(*keys, F.col("keyword").alias("gram")).distinct()
    per_doc = candidate_grams(docs, keys, doc, wanted).withColumn("gram", tk.shown(F.col("gram")))
    return per_doc.join(F.broadcast(wanted), [*keys, "gram"]).groupBy(*keys, F.col("gram").alias("keyword"), doc).agg(
        F.count("*").alias("n"))
