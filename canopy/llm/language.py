"""Language identification by a linear-chain conditional random field that labels the words of a text."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.words import flat, letter_words, map_texts
from canopy.operators.ordering import top_rows

SLOTS = 1 << 17        # hashed features
TRAIN_ROWS = 150       # texts a language is learned from at most
TRAIN_CHARS = 20_000   # longer texts are not learned from
LEXICON = 5_000        # frequent training words with a feature of their own
STEPS = 30
RATE = 0.15
SPAN = 64              # words of a training sequence
PIECE = 1024           # words of a text that are scored in one sweep
KEPT = 200_000         # words whose emissions a worker keeps
BATCH_BYTES = 1_000_000  # of texts that are labelled at once: several vectors per word are held


def _slot(kind: int, *chars: np.ndarray) -> np.ndarray:
    """Slot of each n-gram of character codes: a multiplicative hash, apart for each kind of feature."""
    h = np.full(len(chars[0]), kind * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for c in chars:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(SLOTS)).astype(np.int64)


def feature_rows(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, index of the word each belongs to): 2- and 3-grams of ^word$, prefixes and suffixes of 1 to 3 characters,
    and the word itself if it is in the lexicon."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer("".join(["^" + w + "$" for w in words]).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(n), lengths)
    left = (starts + lengths)[owner] - np.arange(len(chars))  # characters of the word from here on
    two, three = np.flatnonzero(left >= 2), np.flatnonzero(left >= 3)
    slots = [_slot(2, chars[two], chars[two + 1]), _slot(3, chars[three], chars[three + 1], chars[three + 2])]
    owners = [owner[two], owner[three]]
    for k in (1, 2, 3):
        at = np.flatnonzero(lengths >= k + 2)
        begin, end = starts[at] + 1, starts[at] + lengths[at] - 1
        slots += [_slot(4 + k, *(chars[begin + i] for i in range(k))), _slot(8 + k, *(chars[end - k + i] for i in range(k)))]
        owners += [at, at]
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, n)
    at = np.flatnonzero(known >= 0)
    return np.concatenate([*slots, _slot(12, known[at])]), np.concatenate([*owners, at])


def _sums(weights: np.ndarray, slots: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, weights[:, y][slots], n) for y in range(weights.shape[1])], axis=1)


def _scaled(x: np.ndarray, axis) -> np.ndarray:
    return x / np.maximum(x.max(axis=axis, keepdims=True), 1e-300)


def marginals(emit: np.ndarray, offsets: np.ndarray, trans: np.ndarray, span: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over texts of any length: (posterior of each word, forward and backward vectors).

    emit: words x labels, exponentiated. Texts are cut into spans of words; the matrix of a whole span is the product of
    its steps, all spans at once; the spans of a text are chained; then all spans run forward and backward at once from
    the vectors at their ends. The first word of a text is reached from a uniform start over one transition.
    """
    n, labels = emit.shape
    counts = np.diff(offsets)
    per = -(-counts // span)                        # spans of each text
    first = np.concatenate([[0], np.cumsum(per)])
    text_of = np.repeat(np.arange(len(counts)), per)
    place = np.arange(first[-1]) - first[:-1][text_of]
    start = offsets[:-1][text_of] + place * span
    length = np.minimum(span, counts[text_of] - place * span)
    order = np.argsort(-length, kind="stable")      # long spans first: those alive at step t are a prefix
    alive = [int(np.searchsorted(-length[order], -t, side="left")) for t in range(span)]
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    begin = start[order]
    long = np.flatnonzero((per[text_of] > 1)[order])  # only texts of several spans need whole-span matrices
    step = np.zeros((len(order), labels, labels))
    now = np.tile(np.eye(labels), (len(long), 1, 1))
    for t in range(span if len(long) else 0):
        k = int(np.searchsorted(long, alive[t]))
        now[:k] = _scaled((now[:k] @ trans) * emit[begin[long[:k]] + t][:, None, :], (1, 2))
    step[long] = now
    into = np.full((len(order), labels), 1.0)       # forward vector before a span, backward vector after it
    out = np.full((len(order), labels), 1.0)
    deepest = int(per.max(initial=0))
    for depth in range(1, deepest):
        s = np.flatnonzero(place == depth)
        into[rank[s]] = _scaled((into[rank[s - 1]][:, None, :] @ step[rank[s - 1]])[:, 0], 1)
    for depth in range(deepest - 2, -1, -1):
        s = np.flatnonzero((place == depth) & (per[text_of] > depth + 1))
        out[rank[s]] = _scaled((step[rank[s + 1]] @ out[rank[s + 1]][:, :, None])[:, :, 0], 1)
    fore, back = np.empty((n, labels)), np.empty((n, labels))
    a = into.copy()
    for t in range(span):
        k = alive[t]
        if not k:
            break
        a[:k] = _scaled((a[:k] @ trans) * emit[begin[:k] + t], 1)
        fore[begin[:k] + t] = a[:k]
    b = out.copy()
    for t in range(span - 1, -1, -1):
        k = alive[t]
        if not k:
            continue
        back[begin[:k] + t] = b[:k]
        b[:k] = _scaled((emit[begin[:k] + t] * b[:k]) @ trans.T, 1)
    post = fore * back
    return post / post.sum(axis=1, keepdims=True), fore, back


class Model:
    """Learned weights: slots x labels for words, labels x labels for neighbours."""

    def __init__(self, languages: list[str], lexicon: dict[str, int]):
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((SLOTS, len(languages)), np.float32, order="F")
        self.trans = np.zeros((len(languages), len(languages)))

    def emissions(self, words: list[str]) -> np.ndarray:
        e = _sums(self.weights, *feature_rows(words, self.lexicon), len(words))
        return np.exp(e - e.max(axis=1, keepdims=True)) + 1e-12


def fit(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 7) -> Model:
    """Learn from (text, language). Training sequences are made of stretches of 3 to 24 words from texts of any
    language, so that the transitions see switches; log-likelihood plus a small penalty, Adam steps on all of them."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    lists = [(letter_words(t), languages.index(lang)) for t, lang in rows]
    lists = [(w, y) for w, y in lists if w]
    often = Counter(w for x, _ in lists for w in x)
    model = Model(languages, {w: i for i, (w, n) in enumerate(often.most_common(LEXICON)) if n > 2})
    if not lists or len(languages) < 2:
        return model
    stretches = []
    for w, y in lists:
        i = 0
        while i < len(w):
            n = int(rng.integers(3, 25))
            stretches.append((w[i : i + n], y))
            i += n
    order = rng.permutation(len(stretches))
    words = [w for i in order for w in stretches[i][0]]
    label = np.asarray([stretches[i][1] for i in order for _ in stretches[i][0]])
    codes, _, distinct = flat([words])
    offsets = np.unique(np.append(np.arange(0, len(words), SPAN), len(words)))
    slots, owner = feature_rows(list(distinct), model.lexicon)
    labels, n = len(languages), len(words)
    inner = np.ones(n, bool)
    inner[offsets[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((labels, labels))
    np.add.at(seen, (label[at - 1], label[at]), 1)
    observed = np.zeros((len(distinct), labels))
    np.add.at(observed, (codes, label), 1)
    state = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros_like(model.trans), np.zeros_like(model.trans)]
    for s in range(1, steps + 1):
        e = _sums(model.weights, slots, owner, len(distinct))
        e = np.exp(e - e.max(axis=1, keepdims=True)) + 1e-12
        emit, trans = e[codes], np.exp(model.trans - model.trans.max())
        post, fore, back = marginals(emit, offsets, trans)
        expected = np.stack([np.bincount(codes, post[:, y], len(distinct)) for y in range(labels)], axis=1)
        pair = fore[at - 1][:, :, None] * trans[None] * (emit[at] * back[at])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        by_word = (expected - observed) / n
        grad = np.stack([np.bincount(slots, by_word[owner, y], SLOTS) for y in range(labels)]).T.astype(np.float32) + 1e-7 * model.weights
        for x, g, m, v in ((model.weights, grad, *state[:2]), (model.trans, (pair.sum(axis=0) - seen) / n + 1e-7 * model.trans, *state[2:])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= RATE * (m / (1 - 0.9 ** s)) / (np.sqrt(v / (1 - 0.99 ** s)) + 1e-9)
    return model


def training_rows(docs: DataFrame, learn: Column, per_language: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """At most per_language texts of at most chars characters of each language, in the order of their ids' hashes."""
    usable = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= chars)).select("doc_id", "text", "lang")
    picked = top_rows(usable, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")], per_language)
    return sorted(((r["text"], r["lang"]) for r in picked.select("text", "lang").collect()), key=lambda x: (x[1], x[0]))


def identify(docs: DataFrame, learn: Column, keep: list[str] | None = None, **bounds) -> DataFrame:
    """docs (columns keep) with lang_pred, score, n_words and n_switches, from a model learned on the rows where learn holds.

    Every word of a text is labelled by forward-backward; lang_pred is the language with the largest mean posterior and
    score that mean; n_switches counts neighbours whose likeliest labels differ. A text without letters (null, empty) is
    'und' with score 0, and so is all where nothing could be learned. Predictions use the text alone. Learning takes a
    bounded sample (training_rows); texts are scored whole, whatever their length. Repeated rows and null ids stay.
    """
    model = fit(training_rows(docs, learn, **bounds))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept: dict[str, np.ndarray] = {}

    def score(batch: pa.RecordBatch, texts: list) -> list[pa.Array]:
        m = shared.value
        codes, offsets, distinct = flat([letter_words(t) for t in texts])
        counts = np.diff(offsets)
        pred, best, switches = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if m.languages and len(codes):
            emit = np.empty((len(distinct), len(m.languages)))
            fresh = [i for i, w in enumerate(distinct) if w not in kept]
            new = m.emissions([distinct[i] for i in fresh])
            often = np.bincount(codes, minlength=len(distinct)) > 1
            emit[fresh] = new
            for i, w in enumerate(distinct):
                e = kept.get(w)
                if e is not None:
                    emit[i] = e
            for i, e in zip(fresh, new):
                if often[i] and len(kept) < KEPT and len(distinct[i]) < 64:
                    kept[distinct[i]] = e.copy()   # e is a view that would hold all new ones
            post, _, _ = marginals(emit[codes], offsets, np.exp(m.trans - m.trans.max()))
            full = np.flatnonzero(counts)
            mean = np.add.reduceat(post, offsets[:-1][full], axis=0) / counts[full][:, None]
            top = mean.argmax(axis=1)
            best[full] = np.clip(mean[np.arange(len(full)), top], 0.0, 1.0)
            likeliest = post.argmax(axis=1)
            change = np.append(likeliest[1:] != likeliest[:-1], False)
            change[offsets[1:][full] - 1] = False
            switches[full] = np.add.reduceat(change.astype(np.int64), offsets[:-1][full])
            for i, y in zip(full.tolist(), top.tolist()):
                pred[i] = m.languages[y]
        return [pa.array(pred, pa.string()), pa.array(best), pa.array(counts.astype(np.int64)), pa.array(switches)]

    plain = docs.drop("lang_pred", "score", "n_words", "n_switches")
    return map_texts(plain, "text", score, "lang_pred string, score double, n_words long, n_switches long", keep, BATCH_BYTES)
