"""BPE encoding and decoding; long texts are encoded in halves and put together by tree concatenation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.tokenizer import Pieces, chunks, loaded, tokenizer_source

LEAF = 16_384   # characters of a text that one task encodes alone
SEEK = 512      # characters searched for a space near a cut
BATCH_BYTES = 4_000_000
SPACE = " \t\n\x0b\x0c\r"


@dataclass
class Run:
    """Tokens of an unsplit run of characters, with the span of characters each comes from."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


@dataclass
class Part:
    """Tokens of a stretch of text. head and tail are the runs that touch its two ends (None: white space ends there);
    a stretch that is one run has it as head, and whole set. Tokens between the two are final."""

    head: Run | None = None
    middle: list[np.ndarray] = field(default_factory=list)
    tail: Run | None = None
    whole: bool = False

    def ids(self) -> np.ndarray:
        all_of = [*([self.head.ids] if self.head else []), *self.middle, *([self.tail.ids] if self.tail else [])]
        return np.concatenate(all_of) if all_of else np.zeros(0, np.int32)


def encode_run(pieces: Pieces, text: str) -> Run:
    e = pieces.tok.encode(text, add_special_tokens=False)
    spans = np.asarray(e.offsets, dtype=np.int64).reshape(-1, 2)
    return Run(text, np.asarray(e.ids, dtype=np.int32), spans[:, 0], spans[:, 1])


def encode_part(pieces: Pieces, text: str) -> Part:
    words = text.translate(dict.fromkeys(map(ord, SPACE), " ")).split(" ")
    if len(words) == 1:
        return Part(head=encode_run(pieces, text), whole=True) if text else Part()
    head = encode_run(pieces, words[0]) if words[0] else None
    tail = encode_run(pieces, words[-1]) if words[-1] else None
    return Part(head, pieces.ids([" ".join(words[1:-1])]), tail)


def _clean(run: Run, i: int) -> bool:
    """Token i begins where all earlier tokens have ended, so that text may be cut before it."""
    return i == 0 or i >= len(run.ids) or run.starts[i] >= run.ends[:i].max(initial=0)


def join_runs(pieces: Pieces, a: Run, b: Run) -> Run:
    """Tokens of a.text + b.text. A window around the join is encoded again and grows until a token of it is the same,
    over the same characters, as one of a's tokens, and a later one as one of b's. Neighbours in the joint sequence are
    then neighbours in one of three valid encodings, which makes it the encoding of the whole."""
    text, cut, k = a.text + b.text, len(a.text), 4
    far = pieces.special  # a special string across the join lies inside the window
    while True:
        i = min(max(0, len(a.ids) - k), int(np.searchsorted(a.starts, cut - far, "right")))
        j = max(min(len(b.ids), k), int(np.searchsorted(b.starts, far, "left")))
        while i > 0 and not (_clean(a, i) and text[a.starts[i]] != "'"):
            i -= 1
        while j < len(b.ids) and not _clean(b, j):
            j += 1
        lo = int(a.starts[i]) if i > 0 else 0
        hi = cut + (int(b.starts[j]) if j < len(b.ids) else len(b.text))
        w = encode_run(pieces, text[lo:hi])
        at = {(int(t), int(s) + lo, int(e) + lo): n for n, (t, s, e) in enumerate(zip(w.ids, w.starts, w.ends)) if _clean(w, n)}
        left = (0, 0) if i == 0 else None    # tokens taken from a, first token taken from w
        if left is None:
            for n in range(i, len(a.ids) - 1):
                m = at.get((int(a.ids[n]), int(a.starts[n]), int(a.ends[n])))
                if m is not None and _clean(a, n):
                    left = (n, m)
                    break
        right = (len(w.ids), len(b.ids)) if j == len(b.ids) else None  # tokens of w up to here, first token from b
        if right is None:
            for n in range(j - 1, 0, -1):
                m = at.get((int(b.ids[n]), int(b.starts[n]) + cut, int(b.ends[n]) + cut))
                if m is not None and _clean(b, n) and _clean(b, n + 1) and _clean(w, m + 1):
                    right = (m + 1, n + 1)
                    break
        if left and right and left[1] <= right[0]:
            (n, m), (p, q) = left, right
            pick = lambda x, y, z, shift: np.concatenate([x[:n], y[m:p] + (lo if shift else 0), z[q:] + (cut if shift else 0)])
            return Run(text, pick(a.ids, w.ids, b.ids, False).astype(np.int32), pick(a.starts, w.starts, b.starts, True), pick(a.ends, w.ends, b.ends, True))
        k *= 2


def join_parts(pieces: Pieces, a: Part, b: Part) -> Part:
    if not a.head and not a.middle and not a.tail:
        return b
    if not b.head and not b.middle and not b.tail:
        return a
    last, first = (a.head if a.whole else a.tail), b.head
    if last is None or first is None:  # a space at the join: both encodings stand
        middle = [*a.middle, *([a.tail.ids] if a.tail else []), *([b.head.ids] if b.head and not b.whole else []), *b.middle]
        if b.whole:
            return Part(a.head, middle, b.head)
        return Part(a.head, middle, b.tail)
    seam = join_runs(pieces, last, first)
    if a.whole and b.whole:
        return Part(head=seam, whole=True)
    if a.whole:
        return Part(seam, b.middle, b.tail)
    if b.whole:
        return Part(a.head, a.middle, seam)
    return Part(a.head, [*a.middle, seam.ids, *b.middle], b.tail)


def join_tree(pieces: Pieces, parts: list[Part]) -> Part:
    while len(parts) > 1:
        parts = [join_parts(pieces, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def cut_text(text: str, leaf: int, seek: int = SEEK) -> list[str]:
    """Halves of halves, none over leaf by more than seek; cut before a space where one is near, else anywhere."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    near = next((i for i in range(mid, min(mid + seek, len(text))) if text[i] in SPACE), mid)
    return [*cut_text(text[:near], leaf, seek), *cut_text(text[near:], leaf, seek)]


PART_SCHEMA = ("digest binary, place int, middle binary, head_text string, head binary, tail_text string, tail binary, whole boolean")


def _pack(run: Run | None) -> tuple[str | None, bytes | None]:
    return (None, None) if run is None else (run.text, np.stack([run.ids, run.starts, run.ends]).astype(np.int32).tobytes())


def _unpack(text: str | None, raw: bytes | None) -> Run | None:
    if raw is None:
        return None
    ids, starts, ends = np.frombuffer(raw, np.int32).reshape(3, -1)
    return Run(text, ids, starts.astype(np.int64), ends.astype(np.int64))


def _packed(ids: np.ndarray) -> bytes:
    """Token ids in two bytes each where all fit (first byte 2), else in four."""
    wide = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([wide]) + ids.astype(np.uint16 if wide == 2 else np.int32).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.int32, offset=1).astype(np.int32)


def _list_array(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", leaf: int = LEAF, decoded: str | None = None,
           keep: list[str] | None = None) -> DataFrame:
    """docs (columns keep) with the token ids of its whole text (null: empty) in the array column ids, as the tokenizers
    library gives them without added special tokens, truncation or padding; with decoded, also the text that the ids stand
    for, as decode gives it, made in the same pass. For tokenizers that drop white space.

    Texts of over leaf characters are cut into halves of halves that tasks encode in parallel; neighbours are joined in a
    tree, encoding growing windows around each join again until both sides agree. Each such content is encoded once.
    Empty tables, repeated rows and null ids pass through; a text that is one endless word is cut inside the word.
    """
    spark = docs.sparkSession
    source, version = tokenizer_source(tokenizer)
    shipped = spark.sparkContext.broadcast(source)
    made = [ids, *([decoded] if decoded else [])]
    plain = docs.drop(*made)
    columns, kept = plain.columns, [c for c in plain.columns if keep is None or c in keep]
    content = F.coalesce(F.col(text), F.lit(""))
    is_long = F.length(content) > leaf
    kinds = [f"`{ids}` array<int>", *([f"`{decoded}` string"] if decoded else [])]
    schema = ", ".join([*([pa_fields(plain.select(*kept))] if kept else []), *kinds])

    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shipped.value, version)
        for batch in batches:
            texts = pc.fill_null(batch.column(columns.index(text)), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for a, b in chunks(sizes, BATCH_BYTES):
                got = pieces.ids(texts.slice(a, b - a).to_pylist())
                back = [pa.array(pieces.decode(got), pa.string())] if decoded else []
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(columns.index(c)) for c in kept], _list_array(got), *back], [*kept, *made])

    def encode_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(shipped.value, version)
        for f in frames:
            rows = []
            for digest, place, piece in zip(f["digest"], f["place"], f["piece"]):
                p = encode_part(pieces, piece)
                middle = _packed(np.concatenate(p.middle) if p.middle else np.zeros(0, np.int32))
                rows.append((digest, place, middle, *_pack(p.head), *_pack(p.tail), p.whole))
            yield pd.DataFrame(rows, columns=["digest", "place", "middle", "head_text", "head", "tail_text", "tail", "whole"])

    def join_text(f: pd.DataFrame) -> pd.DataFrame:
        pieces = loaded(shipped.value, version)
        parts = []
        for r in f.sort_values("place").itertuples():
            middle = _unpacked(r.middle)
            parts.append(Part(_unpack(r.head_text, r.head), [middle] if len(middle) else [], _unpack(r.tail_text, r.tail), bool(r.whole)))
        whole = join_tree(pieces, parts).ids()
        return pd.DataFrame({"digest": [f["digest"].iloc[0]], "ids": [whole], "decoded": [pieces.decode([whole])[0]]})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for digest, whole in zip(f["digest"], f["content"]):
                part = cut_text(whole, leaf)
                yield pd.DataFrame({"digest": [digest] * len(part), "place": range(len(part)), "piece": part})

    short = plain.filter(~is_long).mapInArrow(encode_short, schema)
    long = plain.filter(is_long).withColumn("_digest", F.unhex(F.sha2(content, 256)))
    # Pieces are dealt once, and equal ones of equal texts meet there.
    pieces_of = long.select(F.col("_digest").alias("digest"), content.alias("content")).mapInPandas(cut, "digest binary, place int, piece string")
    pieces_of = pieces_of.dropDuplicates(["digest", "place"])
    parts = pieces_of.mapInPandas(encode_parts, PART_SCHEMA)
    joined = parts.groupBy("digest").applyInPandas(join_text, "digest binary, ids array<int>, decoded string").toDF("_key", "_ids", "_text")
    found = long.select(*[F.col(f"`{c}`") for c in kept], "_digest").join(joined, F.col("_digest") == F.col("_key"), "left")
    long_ids = found.select(*[F.col(f"`{c}`") for c in kept], F.col("_ids").alias(ids), *([F.col("_text").alias(decoded)] if decoded else []))
    return short.unionByName(long_ids)


def pa_fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that its token ids stand for, special tokens included. Null ids give null."""
    source, version = tokenizer_source(tokenizer)
    shipped = df.sparkSession.sparkContext.broadcast(source)
    plain = df.drop(out)
    columns = plain.columns

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shipped.value, version)
        for batch in batches:
            lists = batch.column(columns.index(ids))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(sizes, BATCH_BYTES // 4):
                part = lists.slice(a, b - a)
                flat, offsets = part.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes[a:b])])
                got = pieces.decode([flat[s:e] for s, e in zip(offsets[:-1], offsets[1:])])
                made = [t if ok else None for t, ok in zip(got, part.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(made, pa.string())], [*columns, out])

    return plain.mapInArrow(texts, pa_fields(plain) + f", `{out}` string")
