"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.words import flat, letter_words, map_texts
from canopy.operators.ordering import top_rows
from canopy.session import cut

SLOTS = 1 << 18
FACTORS = 4
TRAIN_ROWS = {1: 1500, 0: 3000}  # labelled texts learned from at most, by label
TRAIN_CHARS = 20_000             # longer texts are not learned from
STEPS = 80
RATE = 0.1
PENALTY = 1e-4
MIN_TEXTS = 4                    # training texts that a learned term is in at least
MIN_Z = 5.0                      # standard errors by which a learned term's label share is off at least
PREFIXES = (4, 5, 6)


def term_slots(words: list[str]) -> np.ndarray:
    """Slots of each distinct word, words x terms: the word and its prefixes of 4 to 6 characters; -1 where too short."""
    out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
    if not words:
        return out
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(int(lengths.max())):
        at = np.flatnonzero(lengths > i)
        h[at] = (h[at] ^ chars[starts[at] + i]) * np.uint64(0xBF58476D1CE4E5B9)
        h[at] ^= h[at] >> np.uint64(29)
        if i + 1 in PREFIXES:
            at = np.flatnonzero(lengths > i + 1)
            out[at, 1 + PREFIXES.index(i + 1)] = ((h[at] * np.uint64(31 + 2 * i)) >> np.uint64(20)) % np.uint64(SLOTS)
    out[:, 0] = h % np.uint64(SLOTS)
    return out


def text_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each text's distinct terms, offsets of the texts)."""
    codes, offsets, distinct = flat([letter_words(t) for t in texts])
    slots = term_slots(list(distinct))
    parts = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        x = np.unique(slots[np.unique(codes[a:b])])
        parts.append(x[1:] if len(x) and x[0] < 0 else x)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


class Machine:
    """bias, linear weights and factors; terms never seen in training weigh nothing."""

    def __init__(self, seed: int = 11):
        self.bias = -3.0
        self.linear = np.zeros(SLOTS, np.float32)
        self.factors = np.random.default_rng(seed).normal(0, 0.01, (FACTORS, SLOTS)).astype(np.float32)

    def raw(self, slots: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores before the logistic function, and each factor's sum over every text's terms."""
        n = len(offsets) - 1
        owner = np.repeat(np.arange(n), np.diff(offsets))
        out = self.bias + np.bincount(owner, self.linear[slots], n)
        sums = []
        for f in self.factors:
            x = f[slots]
            s = np.bincount(owner, x, n)
            out += 0.5 * (s * s - np.bincount(owner, x * x, n))
            sums.append(s)
        return out, sums

    def score(self, slots: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(slots, offsets)[0], -30, 30)))


def _telling(term: np.ndarray, owner: np.ndarray, labels: np.ndarray, terms: int) -> np.ndarray:
    """True for terms that are tied to the label, among all texts or among those that hold a term found that way (so that
    a term which matters only beside another is found too)."""
    found = np.zeros(terms, bool)
    among = np.ones(len(labels), bool)
    for _ in range(2):
        n, share = among.sum(), labels[among].mean() if among.any() else 0.0
        if n < 2 * MIN_TEXTS or share in (0.0, 1.0):
            break
        inside = among[owner]
        df = np.bincount(term[inside], minlength=terms)
        hits = np.bincount(term[inside], labels[owner[inside]], terms)
        spread = np.sqrt(np.maximum(df * (1 - df / n) * share * (1 - share), 1e-9))
        found |= (df >= MIN_TEXTS) & (np.abs(hits - df * share) >= MIN_Z * spread)
        among = np.bincount(owner, found[term], len(labels)) > 0
    return found


def fit(rows: list[tuple[str, int]]) -> Machine:
    """Learn from (text, label): terms without a tie to the label weigh nothing, the others get weights and factors by
    logistic loss with a penalty, in Adam steps over all rows."""
    m = Machine()
    labels = np.asarray([y for _, y in rows], np.float64)
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        m.bias = -3.0 if not labels.any() else 3.0
        return m
    slots, offsets = text_terms([t for t, _ in rows])
    used, slots = np.unique(slots, return_inverse=True)
    n, owner = len(labels), np.repeat(np.arange(len(labels)), np.diff(offsets))
    telling = _telling(slots, owner, labels, len(used))
    owner, slots = owner[telling[slots]], (np.cumsum(telling) - 1)[slots[telling[slots]]]
    used = used[telling]
    weights = np.concatenate([m.linear[used][None], m.factors[:, used]]).astype(np.float64)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    bias, b1, b2 = m.bias, 0.0, 0.0
    for step in range(1, STEPS + 1):
        raw = bias + np.bincount(owner, weights[0][slots], n)
        sums = []
        for f in weights[1:]:
            x = f[slots]
            s = np.bincount(owner, x, n)
            raw += 0.5 * (s * s - np.bincount(owner, x * x, n))
            sums.append(s)
        wrong = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels) / n
        each = wrong[owner]
        per_term = np.bincount(slots, each, len(used))
        grad = np.stack([per_term, *(np.bincount(slots, each * s[owner], len(used)) - w * per_term for s, w in zip(sums, weights[1:]))]) + PENALTY * weights
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        weights -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
        b1, b2 = 0.9 * b1 + 0.1 * wrong.sum(), 0.99 * b2 + 0.01 * wrong.sum() ** 2
        bias -= RATE * (b1 / (1 - 0.9 ** step)) / (np.sqrt(b2 / (1 - 0.99 ** step)) + 1e-6)
    m.bias, m.factors[:] = float(bias), 0
    m.linear[used], m.factors[:, used] = weights[0], weights[1:]
    return m


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, rows: dict[int, int], chars: int) -> list[tuple[str, int]]:
    """At most rows[label] texts of at most chars characters of each label, in the order of their ids' hashes."""
    marks = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).withColumnRenamed("doc_id", "_id")
    fit_for = F.col("text").isNotNull() & (F.length("text") <= chars)
    known = docs.filter(learn & fit_for).select("doc_id").join(marks, F.col("doc_id") == F.col("_id")).select("doc_id", "_toxic")
    picked = [known.filter(F.col("_toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label, most in sorted(rows.items())]
    ids = cut(reduce(DataFrame.unionByName, picked).select(F.col("doc_id").alias("_id"), "_toxic").distinct(), "training")
    # At most the sum of rows ids: a bound small enough to send to every task, so that no text is shuffled.
    found = docs.filter(fit_for).select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    best = top_rows(found, ["doc_id"], ["text"], 1)
    return sorted((r["text"], r["_toxic"]) for r in best.select("text", "_toxic").collect())


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, rows: dict[int, int] = TRAIN_ROWS, chars: int = TRAIN_CHARS,
                   threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """docs (columns keep) with score, 0 to 1, and predicted, 1 where the score reaches threshold.

    The machine learns from a bounded sample of labelled rows where learn holds (training_rows) and scores whole texts of
    any length by their distinct terms alone. Null and empty texts get the bias as score. A document that is labelled
    twice counts as toxic if it is in one; other labels are left out. With one label or none to learn from, the score is
    a constant. Repeated rows and null ids stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels, learn, rows, chars)))

    def score(batch: pa.RecordBatch, texts: list) -> list[pa.Array]:
        s = shared.value.score(*text_terms(texts))
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return map_texts(docs.drop("score", "predicted"), "text", score, "score double, predicted int", keep)
