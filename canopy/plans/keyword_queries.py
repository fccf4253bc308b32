"""Keyword mining over documents (source = event, lang = domain)."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import vocab
from canopy.functions import tokens as tk
from canopy.functions.text import WORD, WS
from canopy.operators import keywords as kw
from canopy.plans.tables import COMMENTS_SQL, Catalog, comments, with_

catalog = Catalog()

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(vocab.STOPWORDS))
TOKENS_SQL = f"""tokens AS (
  SELECT id_content, domain, comment_id, seq,
         list_filter(list_transform(string_split_regex(regexp_replace(lower(text), '[^{WORD}{WS}]+', '', 'g'),
                     '[{WS}]+'), lambda x: trim(x, '_')), lambda x: x <> '') AS toks
  FROM comments)"""
_VALID = (f"(length({{0}}) >= 3 AND {{0}} NOT IN ({_STOP}) AND NOT starts_with({{0}}, 'http') "
          "AND NOT starts_with({0}, 'www') AND regexp_matches({0}, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]'))")
GRAMS_SQL = """pos AS (
  SELECT domain, id_content, comment_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM tokens),
runs AS (
  SELECT domain, id_content, tok AS a, lead(tok, 1) OVER w AS b, lead(tok, 2) OVER w AS c FROM pos
  WINDOW w AS (PARTITION BY comment_id ORDER BY i)),
per_id AS MATERIALIZED (
  SELECT domain, id_content, 1 AS size, a AS gram, count(*) AS n FROM runs GROUP BY ALL
  UNION ALL SELECT domain, id_content, 2, a || ' ' || b, count(*) FROM runs WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT domain, id_content, 3, a || ' ' || b || ' ' || c, count(*) FROM runs WHERE c IS NOT NULL
  GROUP BY ALL),
stats AS MATERIALIZED (SELECT domain, size, gram, sum(n)::BIGINT AS n, count(*) AS articles FROM per_id GROUP BY ALL),
tot AS (SELECT domain, sum(n) FILTER (size = 1) AS nw, sum(n) FILTER (size = 2) AS np FROM per_id GROUP BY ALL)"""
PMI_SQL = f"""bi AS (
  SELECT s.domain, s.gram, s.n, s.articles, split_part(s.gram, ' ', 1) AS w1, split_part(s.gram, ' ', 2) AS w2
  FROM stats s WHERE s.size = 2 AND s.n >= 3),
pairs AS MATERIALIZED (
  SELECT bi.*, log2((bi.n / tot.np) / ((u1.n / tot.nw) * (u2.n / tot.nw))) AS pmi
  FROM bi JOIN stats u1 ON u1.domain = bi.domain AND u1.size = 1 AND u1.gram = bi.w1
  JOIN stats u2 ON u2.domain = bi.domain AND u2.size = 1 AND u2.gram = bi.w2
  JOIN tot ON tot.domain = bi.domain
  WHERE {_VALID.format('w1')} AND {_VALID.format('w2')}
    AND log2((bi.n / tot.np) / ((u1.n / tot.nw) * (u2.n / tot.nw))) >= 1.0),
often AS MATERIALIZED (
  SELECT domain, gram, n, articles, split_part(gram, ' ', 1) AS a, split_part(gram, ' ', 2) AS b, split_part(gram, ' ', 3) AS c
  FROM stats WHERE size = 3 AND n >= 3),
tri AS (
  SELECT s.domain, s.gram, s.n, s.articles, (p1.pmi + p2.pmi) / 2 AS pmi FROM often s
  JOIN pairs p1 ON p1.domain = s.domain AND p1.w1 = s.a AND p1.w2 = s.b
  JOIN pairs p2 ON p2.domain = s.domain AND p2.w1 = s.b AND p2.w2 = s.c)"""
SCORES_SQL = f"""used AS (SELECT domain, w1 AS w FROM pairs UNION SELECT domain, w2 FROM pairs),
found AS (
  SELECT domain, 'bigram' AS ngram_type, gram, n, articles, pmi FROM pairs
  UNION ALL SELECT domain, 'trigram', gram, n, articles, pmi FROM tri
  UNION ALL SELECT s.domain, 'unigram', s.gram, s.n, s.articles, 0.0 FROM stats s
  LEFT JOIN used ON used.domain = s.domain AND used.w = s.gram
  WHERE s.size = 1 AND used.w IS NULL AND {_VALID.format('s.gram')}),
scored AS (
  SELECT domain, replace(gram, '_', ' ') AS keyword, ngram_type, n AS total_frequency, articles AS total_articles,
         pmi, n * log2(1 + greatest(pmi, 0.0)) AS score FROM found)"""
_BASE = with_(COMMENTS_SQL, TOKENS_SQL, GRAMS_SQL)
_ALL = with_(COMMENTS_SQL, TOKENS_SQL, GRAMS_SQL, PMI_SQL, SCORES_SQL)


def docs(spark, sf):
    return kw.add_tokens(comments(spark, sf))


@catalog.add("t1_tokens", with_(COMMENTS_SQL, TOKENS_SQL) + """
SELECT comment_id, len(toks)::BIGINT AS n_tokens, array_to_string(toks, ' ') AS tokens FROM tokens""")
def t1_tokens(spark, sf):
    d = docs(spark, sf)
    return d.select("comment_id", F.size("tokens").cast("long").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


@catalog.add("f16_valid_tokens", with_(COMMENTS_SQL, TOKENS_SQL) + f"""
SELECT domain, tok AS word, count(*) AS n FROM (SELECT domain, unnest(toks) AS tok FROM tokens)
WHERE {_VALID.format('tok')} GROUP BY ALL""")
def f16_valid_tokens(spark, sf):
    words = docs(spark, sf).select("domain", F.explode("tokens").alias("word"))
    return words.filter(tk.valid_token(F.col("word"))).groupBy("domain", "word").agg(F.count("*").alias("n"))


@catalog.add("a4_unigrams", _BASE + """
SELECT domain, replace(gram, '_', ' ') AS word, sum(n)::BIGINT AS n FROM stats WHERE size = 1 GROUP BY ALL""")
def a4_unigrams(spark, sf):
    return kw.unigram_counts(docs(spark, sf), ["domain"])


@catalog.add("a5_bigrams", _BASE + """
SELECT domain, replace(gram, '_', ' ') AS gram, sum(n)::BIGINT AS n FROM stats WHERE size = 2 GROUP BY 1, 2""")
def a5_bigrams(spark, sf):
    return kw.ngram_counts(docs(spark, sf), ["domain"], 2)


@catalog.add("a5_trigrams", _BASE + """
SELECT domain, replace(gram, '_', ' ') AS gram, sum(n)::BIGINT AS n FROM stats WHERE size = 3 GROUP BY 1, 2""")
def a5_trigrams(spark, sf):
    return kw.ngram_counts(docs(spark, sf), ["domain"], 3)


@catalog.add("w11_adjacent_words", with_(COMMENTS_SQL, TOKENS_SQL) + """
SELECT domain, count(*) FILTER (b IS NOT NULL) AS n_pairs, count(*) FILTER (c IS NOT NULL) AS n_triples,
       count(*) AS n_words
FROM (SELECT domain, lead(tok, 1) OVER w AS b, lead(tok, 2) OVER w AS c
      FROM (SELECT domain, comment_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM tokens)
      WINDOW w AS (PARTITION BY comment_id ORDER BY i)) GROUP BY domain""")
def w11_adjacent_words(spark, sf):
    """Neighbouring words as shifted arrays: no shuffle by document is needed to look one word ahead."""
    toks = F.col("tokens")
    size = F.size(toks).cast("long")
    return docs(spark, sf).groupBy("domain").agg(
        F.sum(F.greatest(size - 1, F.lit(0))).alias("n_pairs"), F.sum(F.greatest(size - 2, F.lit(0))).alias("n_triples"),
        F.sum(size).alias("n_words"))


@catalog.add("a6_bigram_pmi", with_(COMMENTS_SQL, TOKENS_SQL, GRAMS_SQL, PMI_SQL) + """
SELECT domain, gram, n, round(pmi, 6) AS pmi FROM pairs""")
def a6_bigram_pmi(spark, sf):
    """Also J9: bigram counts joined to the counts of both words."""
    pairs = kw.phrase_pmi(docs(spark, sf), ["domain"], 2)
    return pairs.select("domain", "gram", "n", F.round("pmi", 6).alias("pmi"))


@catalog.add("j10_trigram_pmi", with_(COMMENTS_SQL, TOKENS_SQL, GRAMS_SQL, PMI_SQL) + """
SELECT domain, gram, n, round(pmi, 6) AS pmi FROM tri""")
def j10_trigram_pmi(spark, sf):
    return kw.phrase_pmi(docs(spark, sf), ["domain"], 3).select("domain", "gram", "n", F.round("pmi", 6).alias("pmi"))


@catalog.add("a8_keyword_scores", _ALL + """
SELECT domain, keyword, ngram_type, total_frequency, total_articles, round(pmi, 6) AS pmi, round(score, 6) AS score
FROM scored""")
def a8_keyword_scores(spark, sf):
    """Also A7 and J11: words of any kept phrase are left out by an anti join."""
    s = kw.keyword_scores(docs(spark, sf), ["domain"], "id_content")
    return s.withColumn("pmi", F.round("pmi", 6)).withColumn("score", F.round("score", 6))


_TOP = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round(score, 6) DESC, total_frequency DESC, keyword) AS rank
  FROM scored)"""


@catalog.add("k1_top_keywords", _ALL + ",\n" + _TOP + """
SELECT domain, keyword, ngram_type, total_frequency, total_articles, round(pmi, 6) AS pmi, round(score, 6) AS score,
       rank FROM ranked WHERE rank <= 10""")
def k1_top_keywords(spark, sf):
    top = kw.best_keywords(docs(spark, sf), ["domain"], "id_content", 10)["top"]
    return top.withColumn("pmi", F.round("pmi", 6)).withColumn("rank", F.col("rank").cast("long"))


@catalog.add("a7_keyword_details", _ALL + ",\n" + _TOP + """
SELECT p.domain, r.keyword, p.id_content, sum(p.n)::BIGINT AS n FROM ranked r
JOIN per_id p ON p.domain = r.domain AND replace(p.gram, '_', ' ') = r.keyword
WHERE r.rank <= 10 GROUP BY ALL""")
def a7_keyword_details(spark, sf):
    return kw.best_keywords(docs(spark, sf), ["domain"], "id_content", 10)["details"]


@catalog.add("k12_keywords_by_frequency", _ALL + """
SELECT keyword, domain, total_frequency FROM scored ORDER BY total_frequency DESC, keyword, domain LIMIT 20""")
def k12_keywords_by_frequency(spark, sf):
    s = kw.keyword_frequencies(docs(spark, sf), ["domain"])
    return s.select("keyword", "domain", "total_frequency").orderBy(
        F.col("total_frequency").desc(), "keyword", "domain").limit(20)
