"""Node features: TF-IDF over the corpus, joined and scaled feature vectors, cached model vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.text import WORD, squeeze
from canopy.session import cut

TOP, MIN_DF, MAX_DF = 300, 3, 0.9


KEPT = 8192        # terms of a task's summary
CANDIDATES = 1500  # terms that are counted exactly at first
ROWS = 2000        # documents counted at once in a task


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w): words of the lower-case text."""
    return docs.select(key, F.regexp_extract_all(F.lower(squeeze(F.col(text))), F.lit(f"[{WORD}]+"), 0).alias("w"))


def _grams(words: DataFrame, key: str) -> DataFrame:
    """(key, g): words and pairs of neighbouring words, with repeats."""
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return words.select(key, F.concat("w", pairs).alias("g"))


def _coded(batches: Iterator[pa.RecordBatch]):
    """(batch, distinct words, document of each term, code of each term); a pair of words a b has the code a * n + b + n."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            lists = batch.column(batch.schema.get_field_index("w"))
            words = lists.flatten().dictionary_encode()
            code, n = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
            doc = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            near = doc[1:] == doc[:-1]
            pairs = (code[:-1] * n + code[1:] + n)[near]
            yield batch, words.dictionary, np.concatenate([doc, doc[1:][near]]), np.concatenate([code, pairs])


def _spelled(codes: np.ndarray, words: pa.Array) -> list[str]:
    n, known = len(words), words.to_pylist()
    return [known[c] if c < n else f"{known[(c - n) // n]} {known[(c - n) % n]}" for c in codes.tolist()]


def _trimmed(counts: dict[str, int], most: int) -> tuple[dict[str, int], int]:
    """The most frequent terms and the count of the first one left out."""
    if len(counts) <= most:
        return counts, 0
    order = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    return dict(order[:most]), order[most][1]


def frequent_terms(words: DataFrame, kept: int = KEPT) -> tuple[DataFrame, int]:
    """(term, n) and a bound: a term occurs at most n + bound times, one that is absent at most bound times.

    Every task keeps a summary of its most frequent terms; what a summary leaves out is bounded by the largest count it dropped, and
    bounds add up when summaries merge. So a term costs no shuffle, only kept rows of a task do.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        bound = 0
        for _, known, _, codes in _coded(batches):
            found, n = np.unique(codes, return_counts=True)
            if len(found) > kept:
                order = np.argsort(-n, kind="stable")
                bound += int(n[order[kept]])
                found, n = found[order[:kept]], n[order[:kept]]
            for term, x in zip(_spelled(found, known), n.tolist()):
                held[term] = held.get(term, 0) + x
            if len(held) > 2 * kept:
                held, lost = _trimmed(held, kept)
                bound += lost
        held, lost = _trimmed(held, kept)
        terms = [None, *held]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([bound + lost, *held.values()], pa.int64())], ["term", "n"])

    parts = cut(words.select("w").mapInArrow(run, "term string, n long"), "summaries")
    bound = parts.filter("term is null").agg(F.sum("n")).first()[0] or 0
    return parts.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")), bound


def _placed(known: pa.Array, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places) of those terms that a batch's words can spell, by code."""
    n = len(known)
    singles = [t.split(" ") for t in terms]
    at = pc.index_in(pa.array([w for t in singles for w in t], pa.string()), known).to_pylist()
    codes, places, i = [], [], 0
    for place, t in enumerate(singles):
        found, i = at[i : i + len(t)], i + len(t)
        if None not in found:
            codes.append(found[0] if len(t) == 1 else found[0] * n + found[1] + n)
            places.append(place)
    order = np.argsort(np.array(codes, np.int64), kind="stable")
    return np.array(codes, np.int64)[order], np.array(places, np.int64)[order]


def term_counts(words: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, place, tf) of the given terms, place being theirs in the list; one row per document and term that occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, known, docs, codes in _coded(batches):
            own, places = _placed(known, terms)
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
            hit = own[at] == codes
            cell, tf = np.unique(docs[hit] * len(terms) + places[at[hit]], return_counts=True)
            keys = batch.column(batch.schema.get_field_index(key)).take(pa.array(cell // len(terms)))
            yield pa.RecordBatch.from_arrays([keys, pa.array((cell % len(terms)).astype(np.int32)), pa.array(tf.astype(np.int64))], [key, "place", "tf"])

    kind = words.schema[key].dataType.simpleString()
    return words.mapInArrow(run, f"`{key}` {kind}, place int, tf long")


def vocabulary(grams: DataFrame, n_docs: int, top: int = TOP, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """The most frequent terms within the document-frequency bounds, with their smoothed idf and position (in term
    order). At most `top` rows. Both counts are combined before their shuffles; no row per document and term is made."""
    df = grams.select(F.explode(F.array_distinct("g")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = df.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    total = grams.select(F.explode("g").alias("term")).groupBy("term").agg(F.count("*").alias("total"))
    kept = df.join(total, "term").orderBy(F.col("total").desc(), "term").limit(top)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1
    return kept.select("term", "df", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"), rank.alias("place"))


def frequent_vocabulary(words: DataFrame, key: str, n_docs: int, top: int = TOP, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """What vocabulary gives, from summaries of frequent terms: candidates are counted exactly, and the summaries' bound proves that
    no other term is frequent enough. Where it does not, more candidates are tried, at last all terms."""
    spark = words.sparkSession
    found, bound = frequent_terms(words)
    ranked = cut(found.orderBy(F.col("n").desc(), "term").limit(16 * CANDIDATES), "ranked")
    for size in (CANDIDATES, 16 * CANDIDATES):
        first = ranked.orderBy(F.col("n").desc(), "term").limit(size + 1).collect()
        terms = [r["term"] for r in first[:size]]
        others = bound + (first[size]["n"] if len(first) > size else 0)   # no other term occurs more often
        counts = term_counts(words, key, terms).groupBy("place").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        counts = counts.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).collect()
        kept = sorted(((-r["total"], terms[r["place"]], r["df"]) for r in counts))[:top]
        if (len(kept) == top and -kept[-1][0] > others) or others == 0:
            rows = [(t, d, i) for i, (t, d) in enumerate(sorted((t, d) for _, t, d in kept))]
            shown = spark.createDataFrame(rows, "term string, df long, place int")
            return shown.select("term", "df", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"), "place")
    return vocabulary(_grams(words, key), n_docs, top, min_df, max_df)


def tfidf(docs: DataFrame, key: str, text: str = "text", top: int = TOP) -> DataFrame:
    """(key, term, place, value) of the L2-normalised rows; rows without a vocabulary term are absent (zero vectors).
    docs has one row per key. Words are split once and written; one pass finds frequent terms, one counts candidates, one counts
    the vocabulary per document, which is all that is shuffled."""
    words = cut(_words(docs, key, text), "words")
    vocabulary_ = cut(frequent_vocabulary(words, key, words.count(), top), "vocabulary")
    shown = sorted((r["place"], r["term"]) for r in vocabulary_.collect())
    if not shown:
        return words.limit(0).select(key, F.lit("").alias("term"), F.lit(0).alias("place"), F.lit(0.0).alias("value"))
    tf = term_counts(words, key, [t for _, t in shown]).join(F.broadcast(vocabulary_), "place")
    cells = tf.select(key, "term", "place", (F.col("tf") * F.col("idf")).alias("x"))
    by = Window.partitionBy(key)   # at most top cells
    return cells.select(key, "term", "place", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(by))).alias("value"))


def dense_rows(cells: DataFrame, key: str, width: int) -> DataFrame:
    """Sparse cells as one array of width numbers per key, by place in the vocabulary (a few hundred terms)."""
    m = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    return m.select(key, F.array(*[F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0.0)) for i in range(width)]).alias("tfidf"))


def unit(v: Column) -> Column:
    """Vector divided by its length (at least 1e-8)."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x / F.greatest(length, F.lit(1e-8)))


def feature_rows(vectors: DataFrame, tfidf_rows: DataFrame, structure: DataFrame, width: int, key: str = "uid") -> DataFrame:
    """text | tfidf | structure per node, joined by key: unit text vector, TF-IDF as it is (zeros if absent), log1p of
    the counts. vectors: key, x; structure: key, depth, in_degree, sibling_count."""
    zeros = F.array_repeat(F.lit(0.0), width)
    v = vectors.withColumn("_len", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    text = F.transform("x", lambda x: x.cast("double") / F.greatest(F.col("_len"), F.lit(1e-8)))
    s = F.array(*[F.log1p(F.col(c).cast("double")) for c in ["depth", "in_degree", "sibling_count"]])
    joined = v.join(structure, key).join(tfidf_rows, key, "left")
    return joined.select(key, F.concat(text, F.coalesce("tfidf", zeros), s).alias("features"))


def unmatched(left: DataFrame, right: DataFrame, key: str = "uid") -> DataFrame:
    """Keys on one side only, and keys not unique: empty when both sources describe the same nodes."""
    a, b = left.groupBy(key).agg(F.count("*").alias("l")), right.groupBy(key).agg(F.count("*").alias("r"))
    return a.join(b, key, "full_outer").na.fill(0, ["l", "r"]).filter("l <> 1 or r <> 1")


def extend_cache(texts: DataFrame, cache: DataFrame, model: str, embed, dim_type: str = "array<double>") -> DataFrame:
    """Vectors of the texts not cached yet, to append to the cache. cache: key, model, x. embed(list of texts) ->
    vectors, once per Arrow batch; equal texts are embedded once."""
    keyed = texts.select(F.sha2(F.concat_ws("|", F.lit(model), "text"), 256).alias("key"), "text").dropDuplicates(["key"])
    new = keyed.join(cache.filter(F.col("model") == model), "key", "left_anti")

    def run(batches):
        for pdf in batches:
            pdf["x"] = [list(map(float, v)) for v in embed(pdf["text"].tolist())]
            yield pdf[["key", "x"]]

    return new.mapInPandas(run, f"key string, x {dim_type}").withColumn("model", F.lit(model)).select("key", "model", "x")
