"""Quality rules with the perplexity of a modified Kneser-Ney n-gram model of the corpus itself.

The units are the characters of a text's words, joined by single blanks, so n-grams reach across word ends. Word n-grams of a corpus
are nearly as many as its words and could neither be broadcast nor be shuffled to every text within a disk budget of 1.5 times
the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.tokenizer import chunks
from canopy.llm.words import BATCH_BYTES, flat, map_texts, space_words
from canopy.session import cut

ORDER = 4
SPREAD = 3.0          # interquartile ranges that a band reaches beyond the quartiles
SYMBOLS = "#*$%&|<>"


def normal(text: str | None) -> str:
    """The lower-case words of a text with one blank between them."""
    return " ".join(space_words(text.lower())) if text else ""


def ngrams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-gram that ends at each character or at the text's end, index of the text): 16 bits of each code point (those above
    share the 6,400 codes for private use), the start of a text padded with 1, its end marked 2. The key is the n-gram itself."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pad, end = "\x01" * (order - 1), "\x02"
    chars = np.frombuffer("".join([pad + t + end for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    chars = np.where(chars > 0xFFFF, np.uint64(0xE000) + chars % np.uint64(6400), chars)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    owner = np.repeat(np.arange(n), lengths + 1)
    at = np.arange(len(owner)) + owner * (order - 1) + order - 1
    key = np.zeros(len(owner), np.uint64)
    for k in range(order - 1, -1, -1):
        key = (key << np.uint64(16)) | chars[at - k]
    return key, owner


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def count_ngrams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, g, c): how often each n-gram occurs in all texts of each language (null: ''). A task sums up what it reads, in
    stretches of BATCH_BYTES, before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out():
            for name, parts in held.items():
                g, c = _summed(*map(np.concatenate, zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "g", "c"])

        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(sizes, BATCH_BYTES):
                langs = np.asarray(whole.column(0).slice(a, b - a).to_pylist(), object)
                texts = [normal(t) for t in whole.column(1).slice(a, b - a).to_pylist()]
                for name in set(langs.tolist()):
                    g, n = np.unique(ngrams([t for t, own in zip(texts, (langs == name).tolist()) if own and t])[0], return_counts=True)
                    parts = held.setdefault(name, [])
                    parts.append((g, n))
                    if len(parts) >= 16:
                        parts[:] = [_summed(*map(np.concatenate, zip(*parts)))]
                if sum(len(p[0]) for parts in held.values() for p in parts) > 4_000_000:
                    yield from out()
                    held.clear()
        yield from out()

    named = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text"))
    return named.mapInArrow(run, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, part, g, value) of the interpolated model: part 2k holds the discounted probability of each k-gram, part
    2k + 1 the weight that its context leaves to order k - 1 (for k = 1: to each character alike).

    The highest order discounts counts, the others how many different characters come before; discounts for 1, 2 and
    3 or more come from the numbers of n-grams counted 1 to 4 times, by language and order.
    """
    out, level = None, cut(counts, "ngrams")
    for k in range(order, 0, -1):
        seen = [F.sum(F.when(F.col("c") == i, 1.0).otherwise(0.0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        rate = F.expr("n1 / (n1 + 2 * n2)")
        raw = [F.lit(1.0) - 2 * rate * F.col("n2") / F.col("n1"), F.lit(2.0) - 3 * rate * F.col("n3") / F.col("n2"), F.lit(3.0) - 4 * rate * F.col("n4") / F.col("n3")]
        usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
        per_lang = level.groupBy("lang").agg(*seen, F.count("*").alias("kinds"))
        per_lang = per_lang.select("lang", "kinds", *[
            F.when(usable, F.greatest(F.least(x, F.lit(i - 0.1)), F.lit(0.1))).otherwise(0.5 * i).alias(f"d{i}") for i, x in enumerate(raw, 1)])
        own = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = level.join(F.broadcast(per_lang), "lang").withColumn("d", own).withColumn("context", F.shiftrightunsigned("g", 16) if k > 1 else F.lit(0).cast("long"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("left"), F.max("kinds").alias("kinds"))
        probs = rows.join(contexts.select("lang", "context", "total"), ["lang", "context"]).select(
            "lang", F.lit(2 * k).alias("part"), "g", ((F.col("c") - F.col("d")) / F.col("total")).alias("value"))
        share = F.col("left") / F.col("total") / (F.col("kinds") if k == 1 else F.lit(1))
        both = probs.unionByName(contexts.select("lang", F.lit(2 * k + 1).alias("part"), F.col("context").alias("g"), share.alias("value")))
        out = both if out is None else out.unionByName(both)
        if k > 1:
            lower = F.col("g").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))
            level = cut(level.groupBy("lang", lower.alias("g")).agg(F.count("*").alias("c")), "ngrams")
    return out


class Model:
    """The parts as sorted arrays by language: (keys, numbers). Keys are whole n-grams, so none takes another one's number; the
    arrays grow with the n-grams of the corpus."""

    def __init__(self, table: pa.Table, order: int = ORDER):
        self.order, self.parts = order, {}
        langs = table.column("lang").combine_chunks().dictionary_encode()
        names, own = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        part, key, value = table.column("part").to_numpy(), table.column("g").to_numpy().view(np.uint64), table.column("value").to_numpy()
        at = np.lexsort([key, part, own])
        kind = own[at].astype(np.int64) * 1000 + part[at]
        starts = np.flatnonzero(np.diff(kind, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(at)]):
            rows = at[a:b]
            self.parts[names[own[rows[0]]], int(part[rows[0]])] = (key[rows], value[rows].astype(np.float32))

    def _find(self, keys: np.ndarray, lang: str, part: int, missing: float) -> np.ndarray:
        known, values = self.parts.get((lang, part), (np.zeros(0, np.uint64), None))
        if not len(known):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], missing).astype(np.float64)

    def text_scores(self, texts: list[str], lang: str) -> np.ndarray:
        """Natural logarithm of each normal text's probability, its end included."""
        g, owner = ngrams(texts, self.order)
        g, back = np.unique(g, return_inverse=True)
        p = np.full(len(g), 1e-6)
        for k in range(1, self.order + 1):
            key = g & np.uint64((1 << 16 * k) - 1)
            context = key >> np.uint64(16) if k > 1 else np.zeros(len(g), np.uint64)
            p = self._find(key, lang, 2 * k, 0.0) + self._find(context, lang, 2 * k + 1, 1.0) * (p if k > 1 else 1.0)
        return np.bincount(owner, np.log(np.clip(p, 1e-9, 1.0))[back], len(texts))


def build_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count all texts and bring the model's distinct n-grams, 12 bytes each, to the driver."""
    rows = kneser_ney(count_ngrams(docs, text, lang))
    return Model(rows.select("lang", "part", "g", F.col("value").cast("float").alias("value")).toArrow())


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a three-word window which is found twice or more among these word codes."""
    if len(codes) < 4:
        return 0
    size = int(codes.max()) + 1
    pair = codes[:-1] * size + codes[1:]
    if size >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, n = np.unique(pair[:-1] * size + codes[2:], return_inverse=True, return_counts=True)
    hit = n[at] > 1
    if not hit.any():
        return 0
    cover = np.zeros(len(codes), bool)
    for i in range(3):
        cover[i : i + len(hit)] |= hit
    return int(cover.sum())


def repeated_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def add_rules(docs: DataFrame, model: Model, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """docs (columns keep) with the figures of RULES; log_perplexity is per character, null for texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(lang)

    def score(batch: pa.RecordBatch, texts: list) -> list[pa.Array]:
        lists = [space_words(t) for t in texts]
        codes, offsets, distinct = flat(lists)
        langs = np.asarray(["" if x is None else x for x in batch.column(place).to_pylist()], object)
        lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
        total = np.concatenate([[0], np.cumsum(lengths[codes])]) if len(codes) else np.zeros(1, np.int64)
        chars = total[offsets[1:]] - total[offsets[:-1]]
        counts = np.diff(offsets)
        perplexity = np.full(len(texts), np.nan)
        spoken = [normal(t) for t in texts]
        for name in set(langs.tolist()):
            at = np.flatnonzero((langs == name) & (counts > 0))
            if len(at):
                own = [spoken[i] for i in at.tolist()]
                perplexity[at] = -shared.value.text_scores(own, name) / (np.fromiter(map(len, own), np.int64, len(own)) + 1)
        symbols = [sum(map((t or "").count, SYMBOLS)) for t in texts]
        windows = [repeated_words(codes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        return [pa.array(counts.astype(np.int64)), pa.array(chars.astype(np.int64)), pa.array(symbols, pa.int64()), pa.array([repeated_lines(t) for t in texts], pa.int64()),
                pa.array(windows, pa.int64()), pa.array(perplexity, pa.float64(), mask=np.isnan(perplexity))]

    return map_texts(docs, text, score, RULES, keep)


def judge(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", spread: float = SPREAD) -> DataFrame:
    """docs (columns keep and lang) with the figures of RULES, base_failed and kept.

    The model is counted over all texts, the bands over all texts that pass the base rules. A band reaches spread interquartile
    ranges beyond the quartiles; texts outside it are not kept. What is banded is the logarithm of perplexity per character, its distance
    from the language's median over the scatter usual at the text's length (see scatter), as short texts scatter more. Null texts have
    no words and fail the base rules; a null language is one of its own; repeated rows and null ids stay; an empty table gives an
    empty result.
    """
    columns = list(dict.fromkeys([*keep, lang]))
    scored = cut(add_rules(docs, build_model(docs, text, lang), columns, text, lang), "rules")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    passed = scored.filter("not base_failed").select(F.col(lang).alias("of"), F.col("n_words").alias("n"), F.col("log_perplexity").alias("x"))
    usual = cut(scatter(passed), "scatter")
    z = lambda x, n: F.coalesce((x - F.col("middle")) / F.nullif(F.sqrt(F.col("fixed") + F.col("by_length") / n), F.lit(0.0)), F.lit(0.0))
    same = lambda one, other: one.eqNullSafe(other)
    apart = passed.join(F.broadcast(usual.withColumnRenamed("of", "of2")), same(F.col("of"), F.col("of2")))
    bands = apart.groupBy("of").agg(F.percentile_approx(z(F.col("x"), F.col("n")), [0.25, 0.75], 10_000).alias("q"))
    reach = (F.col("q")[1] - F.col("q")[0]) * spread
    bands = bands.select(F.col("of").alias("of2"), (F.col("q")[0] - reach).alias("low"), (F.col("q")[1] + reach).alias("high"))
    limits = cut(usual.join(bands, same(F.col("of"), F.col("of2"))).drop("of2"), "bands")
    packed = limits.select(F.struct(*limits.columns).alias("_limits"))   # one column, so that no name can clash with a caller's
    name = next(c for c in (f"_limits{'_' * i}" for i in range(1 + len(columns))) if c not in columns)
    both = scored.join(F.broadcast(packed.withColumnRenamed("_limits", name)), same(F.col(lang), F.col(f"{name}.of")), "left")
    limit = F.col(name)
    words = F.nullif(F.col("n_words"), F.lit(0).cast("long"))   # worked out for texts without words too
    width = F.nullif(F.sqrt(limit["fixed"] + limit["by_length"] / words), F.lit(0.0))
    place = F.coalesce((F.col("log_perplexity") - limit["middle"]) / width, F.lit(0.0))
    inside = (place >= limit["low"]) & (place <= limit["high"])
    return both.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop(name)


def scatter(texts: DataFrame) -> DataFrame:
    """(of, middle, fixed, by_length) of every language from rows (of, n, x): the median of x, and its squared interquartile range at n
    words as fixed + by_length / n. Texts differ from each other by a fixed part, and a mean over n words by a part that falls with n;
    both follow from the interquartile ranges of the shorter and the longer half."""
    at = texts.groupBy("of").agg(F.percentile_approx("x", 0.5, 10_000).alias("middle"), F.percentile_approx("n", 0.5, 10_000).alias("half"))
    halves = texts.join(F.broadcast(at.withColumnRenamed("of", "of2")), F.col("of").eqNullSafe(F.col("of2"))).withColumn("long", F.col("n") > F.col("half"))
    pick = lambda value, long: F.when(F.col("long") == F.lit(long), value)
    range2 = lambda long: F.expr(f"power(percentile_approx(if(long = {str(long).lower()}, x, null), 0.75, 10000) - percentile_approx(if(long = {str(long).lower()}, x, null), 0.25, 10000), 2)")
    both = halves.groupBy("of").agg(F.first("middle").alias("middle"), range2(False).alias("v1"), range2(True).alias("v2"),
                                    F.avg(pick(1 / F.col("n"), False)).alias("u1"), F.avg(pick(1 / F.col("n"), True)).alias("u2"))
    slope = F.greatest(F.lit(0.0), F.coalesce((F.col("v1") - F.col("v2")) / F.nullif(F.col("u1") - F.col("u2"), F.lit(0.0)), F.lit(0.0)))
    both = both.withColumn("by_length", slope)
    fixed = F.greatest(F.lit(0.0), F.coalesce(F.col("v2") - F.col("by_length") * F.col("u2"), F.col("v1")))
    return both.select("of", "middle", fixed.alias("fixed"), "by_length")
