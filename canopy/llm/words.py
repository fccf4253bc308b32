"""Batches of texts as flat arrays of word codes, for numpy work inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from canopy.llm.bpe import pa_fields
from canopy.llm.tokenizer import chunks

BATCH_BYTES = 4_000_000
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORD = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; runs of number signs that are no digits do not count."""
    found = LETTER_WORD.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def space_words(text: str | None) -> list[str]:
    """Runs of anything but ASCII white space."""
    return SPACE_WORD.findall(text) if text else []


def flat(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each word, offsets of the texts, distinct words)."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    words = np.empty(offsets[-1], dtype=object)
    words[:] = [w for x in lists for w in x]
    codes, distinct = pd.factorize(words)
    return codes, offsets, distinct


def map_texts(df: DataFrame, text: str, score: Callable[[pa.RecordBatch, list], list[pa.Array]], added: str, keep: list[str] | None = None,
              batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """df's columns keep (default all) with the columns added ("name type, ..."), which score makes of each batch and its
    texts; batches hold about batch_bytes of text."""
    columns = df.columns
    kept = columns if keep is None else keep
    names = [*kept, *[x.split()[0].strip("`") for x in added.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(columns.index(text))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(sizes, batch_bytes):
                part = batch.slice(a, b - a)
                made = score(part, part.column(columns.index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(columns.index(c)) for c in kept], *made], names)

    return df.mapInArrow(run, ", ".join([*([pa_fields(df.select(*kept))] if kept else []), added]))
