"""A public tokenizer inside Spark tasks: one instance per Python worker and a bounded cache of pre-token encodings.

The library cuts a text into pre-tokens and encodes each one alone. For the two pipelines known here (byte-level; NFC,
lower case, split by pattern, byte-level) plain Latin texts are cut in Python by the pattern that the tokenizer names, and
each distinct pre-token goes through the library's model once. All other texts, and all other tokenizers, take the
library's own path whole; results are the same.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter

import numpy as np
import regex

# Texts with any of these take the library's path: characters beyond Latin, odd white space, special strings, dotted I.
NOT_PLAIN = regex.compile("[^\t-\r -~¡-ɏ]|İ|<\\|")
# The pattern that byte-level pre-tokenizers of this file format imply (fixed value of the format).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 250_000  # pre-tokens a worker keeps
LONG = 64         # characters; longer pre-tokens are not kept
_LOADED: dict[str, "Pieces"] = {}


def tokenizer_source(path: str) -> tuple[str, str]:
    """The tokenizer file's text (a few MB, shipped to every task) and its version digest."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return text, hashlib.sha256(text.encode()).hexdigest()


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _plain_rule(spec: dict):
    """(pattern, lower case) by which plain Latin texts are cut, or None for a pipeline not known here."""
    kinds = lambda x, key: [x["type"]] if x and x["type"] != "Sequence" else [y["type"] for y in x[key]] if x else []
    norm, pre = spec["normalizer"], spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        return None
    steps = kinds(pre, "pretokenizers")
    if not norm and steps == ["ByteLevel"] and pre["use_regex"] and not pre["add_prefix_space"]:
        return BYTE_PATTERN, False
    if kinds(norm, "normalizers") == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"]:
        split, level = pre["pretokenizers"]
        if split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and not level["add_prefix_space"]:
            return split["pattern"]["Regex"], True
    return None


class Pieces:
    """Encodes lists of texts; results of frequent pre-tokens are kept for later batches of the same worker."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(source)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(source)
        rule = _plain_rule(spec)
        self.cut = regex.compile(rule[0]).findall if rule else None
        self.lower = bool(rule and rule[1])
        self.letters = _byte_letters()
        self.translate = {b: c for b, c in enumerate(self.letters)}
        self.kept: dict[str, bytes] = {}
        self.names: list[str] | None = None
        self.special = max([1, *(len(x["content"]) for x in spec["added_tokens"])])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _pre_tokens(self, text: str) -> list[str] | None:
        if self.cut is None or NOT_PLAIN.search(text):
            return None
        return self.cut(text.lower() if self.lower else text)

    def _model(self, pre: str) -> bytes:
        shown = pre.encode().decode("latin-1").translate(self.translate)
        return np.asarray([t.id for t in self.tok.model.tokenize(shown)], dtype=np.int32).tobytes()

    def _known(self, cut: list[list[str] | None]) -> dict[str, bytes]:
        """Encodings of all these pre-tokens; of the new ones, those that recur are kept while there is room."""
        seen: Counter = Counter()
        for c in cut:
            if c is not None:
                seen.update(c)
        known = {}
        for pre, n in seen.items():
            got = self.kept.get(pre)
            if got is None:
                got = self._model(pre)
                if n > 1 and len(self.kept) < CACHED and len(pre) <= LONG:
                    self.kept[pre] = got
            known[pre] = got
        return known

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut = [self._pre_tokens(t) for t in texts]
        known = self._known(cut)
        whole = iter(self.encode([t for t, c in zip(texts, cut) if c is None]))
        return [np.asarray(next(whole), np.int32) if c is None else np.frombuffer(b"".join(map(known.__getitem__, c)), np.int32) for c in cut]

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        cut = [self._pre_tokens(t) for t in texts]
        known = {p: len(x) // 4 for p, x in self._known(cut).items()}
        whole = iter(self.encode([t for t, c in zip(texts, cut) if c is None]))
        return [len(next(whole)) if c is None else sum(map(known.__getitem__, c)) for c in cut]

    def token_names(self) -> list[str]:
        if self.names is None:
            self.names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        return self.names

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """As the library decodes with skip_special_tokens=False; without a decoder that joins the token strings."""
        if self.tok.decoder is not None:
            return self.tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
        names = self.token_names()
        return [" ".join(map(names.__getitem__, x.tolist())) for x in ids]


def loaded(source: str, version: str) -> Pieces:
    """The worker's instance for this tokenizer version."""
    if version not in _LOADED:
        _LOADED[version] = Pieces(source)
    return _LOADED[version]


def chunks(sizes: np.ndarray, most: int):
    """Consecutive slices of rows whose sizes sum to about most (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
