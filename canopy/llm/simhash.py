"""SimHash fingerprints of word shingles and their near-duplicate groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.bpe import pa_fields
from canopy.llm.components import components
from canopy.llm.tokenizer import chunks
from canopy.session import cut

WIDTH = 3            # words of a shingle
SEED = 42
DISTANCE = 2         # differing bits that still link
LIGHT = 32           # fingerprints of one index list that are compared pair by pair
BATCH_BYTES = 1_000_000
PAIRS = list(combinations(range(4), 2))


def simhash(texts: list[str | None], width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Fingerprints: A-Z lower-cased, words between ASCII white space, all shingles; a bit is set if over half have it."""
    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for t in texts:
        words = (t or "").encode().lower().split()
        n = len(words)
        if n <= width:
            part = [digest(b" ".join(words), seed)] if n else []
        else:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            part = [digest(line[s:e], seed) for s, e in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())]
        hashes += part
        counts.append(len(part))
    out = np.zeros(len(texts), np.uint64)
    counts = np.asarray(counts)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.asarray(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        over = (2 * ones > counts[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the 64-bit fingerprint of its whole text; null and wordless texts have fingerprint zero."""
    plain = docs.drop(out)
    columns = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(columns.index(text))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(sizes, BATCH_BYTES):
                got = pa.array(simhash(texts.slice(a, b - a).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, got], [*columns, out])

    return plain.mapInArrow(run, pa_fields(plain) + f", `{out}` long")


def _two_bytes(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _shared_bytes(x: Column) -> Column:
    """Positions of eight at which two fingerprints hold the same byte, from their exclusive or."""
    return reduce(lambda a, b: a + b, [(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for i in range(8)])


def links(fingerprints: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints linked through steps of at most two differing bits.

    Two bits lie in two bytes at most, so linked fingerprints share at least 6 of 8 positional bytes, hence two of the
    four double bytes whole. The index lists fingerprints under every two double bytes by position (6 entries each).
    Lists of up to LIGHT are compared pair by pair by the bit count, which implies any count of shared bytes. In longer lists, where pairs would grow with the square, fingerprints meet at what lies between
    them: two are within 2 bits exactly if some value is within 1 bit of both; each such value has 65 neighbours at most.
    """
    index = fingerprints.select(F.col(fp).alias("fp"), F.posexplode(F.array(*[
        F.shiftleft(_two_bytes(F.col(fp), i), 16).bitwiseOR(_two_bytes(F.col(fp), j)) for i, j in PAIRS])).alias("kind", "key"))
    index = cut(index.select((F.col("kind") * F.lit(2**32) + F.col("key")).alias("key"), "fp"), "index")
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    listed = cut(index.join(sizes, "key"), "lists")
    light = listed.filter(F.col("n") <= LIGHT)
    other = light.select("key", F.col("fp").alias("b"))
    pairs = light.select("key", F.col("fp").alias("a")).join(other, "key").filter("a < b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = pairs.filter((_shared_bytes(x) >= 8 - DISTANCE) & (F.bit_count(x) <= DISTANCE)).select("a", "b")
    heavy = listed.filter(F.col("n") > LIGHT).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    meet = heavy.select("fp", F.explode(around).alias("middle")).groupBy("middle").agg(F.collect_list("fp").alias("fps"))
    star = meet.filter(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return near.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest doc_id among all rows reachable
    over links of at most two differing bits, the row's own included.

    Equal fingerprints are one node, so copies, however many, make no pairs. Null and wordless texts share fingerprint
    zero and are linked like any other; null ids never become a component's id (a component of null ids has null);
    repeated rows are kept. An empty table gives an empty result.
    """
    prints = cut(add_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "prints")
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    label = components(links(nodes, "fingerprint"))
    grouped = nodes.join(label, nodes.fingerprint == label.node, "left").select(
        F.col("fingerprint").alias("fp"), F.coalesce("label", "fingerprint").alias("label"), "first")
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    groups = grouped.join(smallest, "label").select("fp", "component_id")
    return prints.join(groups, F.col("fingerprint") == F.col("fp"), "left").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each near-duplicate group: that with the smallest id, the first of equal ids by content.
    Groups without any id keep one row too."""
    from pyspark.sql import Window

    groups = near_duplicates(docs, text, doc_id)
    keep = groups.filter("component_id is not null").select(F.col("component_id").alias("_keep")).distinct()
    named = docs.join(keep, F.col(doc_id) == F.col("_keep"), "left_semi")
    content = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    by = Window.partitionBy(doc_id).orderBy(content, F.col(text).isNull())
    kept = named.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
    nameless = groups.filter("component_id is null").select("fingerprint").distinct()
    lone = add_fingerprint(docs.filter(F.col(doc_id).isNull()), text, "_fp").join(nameless, F.col("_fp") == F.col("fingerprint"), "left_semi")
    one = lone.withColumn("_n", F.row_number().over(Window.partitionBy("_fp").orderBy(content))).filter("_n = 1").drop("_n", "_fp")
    return kept.unionByName(one)
