"""Near-duplicate groups of texts: SimHash groups, checked and completed by an exact prefix-filtered Jaccard join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.bpe import pa_fields
from canopy.llm.components import components
from canopy.llm.line_dedup import _level, _slot, _table
from canopy.llm.simhash import near_duplicates
from canopy.llm.tokenizer import chunks
from canopy.operators.ordering import top_rows
from canopy.session import cut, discard

WIDTH = 5             # words of a shingle
OVER, UNDER = 4, 5    # least Jaccard similarity of two texts' shingle sets, as a fraction
WIDE = 8              # 64-bit sketches that candidates are compared by before their sets
LIGHT = 32            # texts of one prefix shingle that are compared pair by pair
LEADERS = 4           # texts that all texts of a longer list meet first
BATCH_BYTES = 1_000_000
LOW = np.uint64(2**48 - 1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words between ASCII white space; a text of fewer
    words than width has one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    m = max(n - width + 1, 1)
    out = np.full(m, min(n, width), np.uint64)
    for k in range(min(n, width)):
        out = (out ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def _mapped(df: DataFrame, made, added: str) -> DataFrame:
    """df without text, with the columns added, which made gives for a list of texts."""
    columns = df.columns
    kept = [c for c in columns if c != "text"]
    names = [*kept, *[x.split()[0] for x in added.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(columns.index("text"))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(sizes, BATCH_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(columns.index(c)) for c in kept], *made(texts.slice(a, b - a).to_pylist())], names)

    return df.mapInArrow(run, f"{pa_fields(df.select(*kept))}, {added}")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _order(docs: DataFrame, width: int) -> np.ndarray:
    """Rank of each value of a shingle's upper 16 bits, rare ones first. With the lower bits it is an order of all
    shingles; any order gives the same result, this one keeps common passages out of the prefixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += np.bincount((shingles(t, width) >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    counted = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << 16, np.int64)
    n[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    rank = np.empty(1 << 16, np.uint64)
    rank[np.argsort(n, kind="stable")] = np.arange(1 << 16, dtype=np.uint64)
    return rank


def _need(total: Column) -> Column:
    """Least number of shared shingles of two sets with so many in total."""
    return F.floor((total * OVER + (OVER + UNDER - 1)) / (OVER + UNDER))


def _near() -> Column:
    """Length and positional filters for two sets that share the shingles at these places of their orders."""
    fits = (F.col("n_a") * UNDER >= F.col("n_b") * OVER) & (F.col("n_b") * UNDER >= F.col("n_a") * OVER)
    return fits & (F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) >= _need(F.col("n_a") + F.col("n_b")))


def _pairs(left: DataFrame, right: DataFrame, extra: Column) -> DataFrame:
    side = lambda df, s: df.select("key", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "key"])
    met = side(left, "a").join(side(right, "b"), "key").filter((F.col("node_a") != F.col("node_b")) & _near() & extra)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of OVER / UNDER or more."""
    pairs = cut(pairs.distinct(), "pairs")
    sketch = [f"s{i}" for i in range(WIDE)]
    named = lambda df, s: df.select(*[F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in df.columns])
    wide = nodes.select("node", "n", *sketch)
    apart = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in sketch), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    few = cut(pairs.join(named(wide, "a"), "a").join(named(wide, "b"), "b").filter(apart <= total - 2 * _need(total)).select("a", "b"), "few")
    ids = few.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = cut(nodes.select("node", "row").join(ids, "node", "left_semi"), "wanted")
    # Only texts that may be wanted move: a fixed-size table of their rows' slots tells.
    marks = _table(wanted.groupBy(_slot(F.col("row")).alias("slot")).agg(F.count("*").alias("n")))
    held = docs.select("row", "text").withColumn("_t", marks.scalar()).filter(_level("_t", F.col("row")) > 1).select("row", "text")
    texts = held.join(wanted, "row").select("node", "text")
    sets = cut(_mapped(texts, lambda ts: [_lists([shingles(t, width) for t in ts])], "words array<long>").dropDuplicates(["node"]), "sets")
    both = F.size(F.array_intersect("words_a", "words_b"))
    similar = both * UNDER >= (F.size("words_a") + F.size("words_b") - both) * OVER
    found = cut(few.join(named(sets, "a"), "a").join(named(sets, "b"), "b").filter(similar).select("a", "b"), "similar")
    discard(pairs, few, wanted, marks, sets)
    return found


def _alike(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that SimHash's index groups together: each group's smallest node with its others."""
    groups = near_duplicates(rows, "text", "row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("grp"))
    member = cut(prints.select("row", "node").join(groups, "row").select("grp", "node").distinct(), "groups")
    least = member.groupBy("grp").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return member.join(least, "grp").filter("node <> a").select("a", F.col("node").alias("b"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """docs with one row of each near-duplicate group: that with the smallest id (null ids last), of equal ids the first
    by content.

    Texts are linked if the sets of their shingles have a Jaccard similarity of 0.8 or more, and groups are what is
    reachable over links. The groups of the SimHash operator come first, each member checked against its group's first;
    as no distance of fingerprints tells a Jaccard similarity, the prefix filter then finds what they miss. Shingles are compared as 64-bit hashes. Equal sets are one node, so copies, however many, make
    no pairs; texts without words are one group. Every text's shingles are ordered alike, and similar sets share one of
    their first fifth (the prefix). Texts that share a prefix shingle are compared pair by pair in lists of up to LIGHT;
    in longer lists all meet the list's LEADERS first, and then only those that are not in one group yet meet each other.
    """
    content = F.coalesce(F.sha2(F.col(text), 256), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("row"), content.alias("content"))
    rank = docs.sparkSession.sparkContext.broadcast(_order(rows, width))

    def made(texts: list) -> list[pa.Array]:
        keys = [np.sort((rank.value[(h >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | (h & LOW)) for h in (shingles(t, width) for t in texts)]
        n = [len(k) for k in keys]
        odd = np.array([np.bincount((k & np.uint64(64 * WIDE - 1)).astype(np.int64), minlength=64 * WIDE) & 1 for k in keys], np.uint8)
        bits = np.packbits(odd.reshape(len(keys), 64 * WIDE), axis=1, bitorder="little").view(np.int64)
        node = np.array([xxhash.xxh64_intdigest(k.tobytes()) for k in keys], np.uint64).view(np.int64)
        first = _lists([k[: len(k) - (len(k) * OVER + UNDER - 1) // UNDER + 1] for k in keys])
        return [pa.array(node), pa.array(n, pa.int32()), first, *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(WIDE)]]

    added = "node long, n int, prefix array<long>, " + ", ".join(f"s{i} long" for i in range(WIDE))
    prints = cut(_mapped(rows, made, added), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "content", "row").alias("at")
    heads = cut(prints.groupBy("node").agg(F.min(order).alias("at")), "heads")
    firsts = heads.select(F.col("at.row").alias("row"))
    nodes = cut(prints.join(firsts, "row", "left_semi").drop("doc_id", "content"), "nodes")
    listed = nodes.select("node", "n", F.posexplode("prefix").alias("p", "key"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    listed = cut(listed.join(sizes, "key"), "lists")
    light, heavy = listed.filter(F.col("size") <= LIGHT).drop("size"), listed.filter(F.col("size") > LIGHT).drop("size")
    pairs = _pairs(light, light, F.col("node_a") < F.col("node_b")).unionByName(_alike(rows, prints))
    some = heavy.limit(1).count() > 0
    if some:
        pairs = pairs.unionByName(_pairs(top_rows(heavy, ["key"], ["node"], LEADERS), heavy, F.lit(True)))
    links = _verified(pairs, nodes, rows, width)
    if some:
        label = components(links)
        named = heavy.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = cut(named, "labelled")
        mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
        open_ = cut(named.join(mixed, "key", "left_semi"), "open")
        more = _verified(_pairs(open_, open_, (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b"))), nodes, rows, width)
        links = links.unionByName(more)
        discard(named, open_)
    label = components(links)
    best = heads.join(label, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("at").alias("at"))
    best = cut(best.select(F.col("at.row").alias("_row")), "best")
    # Rows that stay and have no copy need no join: a fixed-size table of the others' slots tells most of them.
    single = prints.groupBy("row").agg(F.count("*").alias("n")).join(best.withColumnRenamed("_row", "row").withColumn("best", F.lit(True)), "row", "left")
    other = single.filter("best is null or n > 1")
    marks = _table(other.groupBy(_slot(F.col("row")).alias("slot")).agg(F.count("*").alias("n")))
    marked = docs.withColumn("_row", F.xxhash64(doc_id, text)).withColumn("_t", marks.scalar())
    marked = marked.withColumn("_some", _level("_t", F.col("_row")) > 1).drop("_t")
    few = marked.filter("_some").join(best, "_row", "left_semi")
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy("_row"))).filter("_n = 1")
    kept = marked.filter("not _some").select(*docs.columns).unionByName(few.select(*docs.columns))
    discard(prints, heads, nodes, listed)
    return kept
