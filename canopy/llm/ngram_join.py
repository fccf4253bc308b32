"""Groups of texts by the Jaccard similarity of their word n-grams: a join over prefix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.components import components
from canopy.llm.shingles import LOW, OVER, UNDER, WIDE, _lists, _mapped, _order, _pairs, _verified, shingles
from canopy.operators.ordering import spread_rows, top_rows
from canopy.session import cut, discard

WIDTH = 5       # words of an n-gram
LIGHT = 32      # sets that list one n-gram, up to which they go into one tree with the lists of the same first set
LEADERS = 4     # sets that all sets of a longer list meet first
BLOCK = 1024    # sets of one block of a longer list
CHUNK = 512     # n-grams of a first set whose lists make one tree
SKETCH = [f"s{i}" for i in range(WIDE)]
WIDER = 2048    # bits of the parity sketch that candidates of a tree are compared by


def need(total: np.ndarray | int) -> np.ndarray | int:
    """Least number of shared n-grams of two sets with so many in total."""
    return -(-total * OVER // (OVER + UNDER))


class PrefixTree:
    """Sets' first n-grams in the global order as paths of a tree; sets with a common beginning share its nodes. A node spans the
    sets lo to hi of the sorted ones, holds the n-grams start to end of their paths, and the least and most n-grams of its sets. Paths
    may leave out n-grams that no other set has among its first ones: they match nothing."""

    def __init__(self, paths: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].byteswap().tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes = sizes[self.order]
        length = np.array([len(p) for p in self.paths])
        common = np.zeros(len(paths) + 1, np.int64)
        for i in range(1, len(paths)):
            m = min(length[i - 1], length[i])
            apart = np.flatnonzero(self.paths[i - 1][:m] != self.paths[i][:m])
            common[i] = apart[0] if len(apart) else m
        self.nodes = []
        open_ = [(0, len(paths), 0, None)]
        while open_:
            lo, hi, start, parent = open_.pop()
            end = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(length[lo])
            own = lo + int((length[lo:hi] == end).sum())   # sets whose path ends here come first
            if parent is not None:
                self.nodes[parent][5].append(len(self.nodes))
            self.nodes.append((lo, hi, start, end, own, [], int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max())))
            cuts = [own, *(own + 1 + np.flatnonzero(common[own + 1 : hi] == end)).tolist(), hi] if own < hi else []
            for a, b in zip(cuts, cuts[1:]):
                open_.append((a, b, end, len(self.nodes) - 1))

    def probe(self, path: np.ndarray, size: int, allowed: np.ndarray) -> list[int]:
        """Places of the allowed sets that share an n-gram of path and may reach the similarity: overlaps are counted once for
        all sets of a node, and a node is left when even all n-grams to come would not be enough."""
        some = np.concatenate([[0], np.cumsum(allowed)])
        found, open_ = [], [(0, 0, 0)]
        while open_:
            v, seen, shared = open_.pop()
            lo, hi, start, end, own, children, least, most = self.nodes[v]
            if some[hi] == some[lo]:
                continue
            used, over = end, False
            if end > start:
                part = self.paths[lo][start:end]
                known = int(np.searchsorted(part, path[-1], side="right"))   # beyond path's last n-gram nothing is known
                if known:
                    at = np.searchsorted(path, part[:known])
                    same = path[at] == part[:known]
                    shared += int(same.sum())
                    seen = int(at[-1]) + int(same[-1])
                if known < end - start:
                    used, over, seen = start + known, True, len(path)
            if shared + min(size - seen, most - used) < need(size + least):
                continue
            last = hi if over else own
            if shared and some[last] > some[lo]:
                at = lo + np.flatnonzero(allowed[lo:last])
                n = self.sizes[at]
                found += at[shared + np.minimum(size - seen, n - used) >= need(size + n)].tolist()
            if not over:
                open_ += [(c, seen, shared) for c in children]
        return found


def _closest(places: list[tuple[np.ndarray, ...]], first: int) -> np.ndarray:
    """Rows that are among the first of every kind of group: each kind gives a row's group; rows come closest first."""
    keep = np.arange(len(places[0][0]))
    for group in places:
        at = np.lexsort([keep, *[g[keep] for g in group]])
        ends = np.any([np.diff(g[keep][at], prepend=g[keep][at][:1] - 1) != 0 for g in group], axis=0)
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(ends, np.arange(len(at)), 0))
        keep = np.sort(keep[at[rank < first]])
    return keep


def _tree_pairs(group: pa.Table, first: int | None) -> list[np.ndarray]:
    """(a, b, differing sketch bits, whether closer ones hid others) of the pairs of one group's sets that may be similar. Pairs need
    different sides and labels where the group has them; then only the first closest ones of a set and of two labels are given."""
    column = lambda c: group.column(c).to_numpy()
    lists = group.column("path").combine_chunks()
    flat, at = lists.flatten().to_numpy().view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    paths = [flat[a:b] for a, b in zip(at, at[1:])]
    tree = PrefixTree(paths, column("n").astype(np.int64))
    ids, sizes = column("node")[tree.order], tree.sizes
    bits = np.stack([column(s) for s in SKETCH], axis=1)[tree.order].view(np.uint64)
    wider = np.stack([np.frombuffer(x, np.uint64) for x in group.column("wider").to_pylist()])[tree.order]
    tags = [column(c)[tree.order] for c in ("side", "label") if c in group.column_names]
    rows = [np.zeros((3, 0), np.int64)]
    for i in range(1, len(ids)):
        n, m = int(sizes[i]), sizes[:i]
        apart = np.bitwise_count(bits[:i] ^ bits[i]).sum(axis=1, dtype=np.int64)
        allowed = (n * UNDER >= m * OVER) & (m * UNDER >= n * OVER) & (apart <= n + m - 2 * need(n + m))
        for t in tags:
            allowed &= t[:i] != t[i]
        near = np.flatnonzero(allowed)
        if len(near):   # the wider sketch leaves few pairs that are not similar
            apart[near] = np.bitwise_count(wider[near] ^ wider[i]).sum(axis=1, dtype=np.int64)
            allowed[near] = apart[near] <= n + m[near] - 2 * need(n + m[near])
        if allowed.any():
            at = np.array(tree.probe(tree.paths[i], n, np.concatenate([allowed, np.zeros(len(ids) - i, bool)])), np.int64)
            rows.append(np.stack([np.full(len(at), i), at, apart[at]]))
    i, j, apart = np.concatenate(rows, axis=1)
    keep = np.argsort(apart, kind="stable")
    i, j, apart = i[keep], j[keep], apart[keep]
    if first is not None and len(i):
        label = tags[-1]
        keep = _closest([(i,), (np.minimum(label[i], label[j]), np.maximum(label[i], label[j]))], first)
        hidden, i, j, apart = len(keep) < len(i), i[keep], j[keep], apart[keep]
    else:
        hidden = False
    return [np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), apart, np.full(len(i), hidden)]


def _joined(groups: DataFrame, nodes: DataFrame, keys: list[str], first: int | None = None) -> DataFrame:
    """(a, b, apart, hidden) from all groups (keys, node, maybe side and label): a prefix tree per group, in sorted partitions. nodes
    has what a tree needs of a set: n, path, the sketch and a wider one."""
    members = groups.join(nodes, "node")
    packed = members.repartition(*keys).sortWithinPartitions(*keys)

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        change = np.ones(table.num_rows, bool)
        same = [table.column(k).to_numpy() for k in keys]
        change[1:] = np.any([v[1:] != v[:-1] for v in same], axis=0)
        starts = [*np.flatnonzero(change).tolist(), table.num_rows]
        parts = [_tree_pairs(table.slice(a, b - a), first) for a, b in zip(starts, starts[1:]) if b - a > 1]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["a", "b", "apart", "hidden"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = lambda b, i: [b.column(b.schema.get_field_index(k))[i].as_py() for k in keys]
        for batch in batches:
            if not batch.num_rows:
                continue
            end = last(batch, -1)
            if held and last(held[-1], -1) != end or last(batch, 0) != end:   # a group ends in this batch
                same = np.all([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) == v for k, v in zip(keys, end)], axis=0)
                cut_at = int(np.argmax(same))
                yield from found(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
                held = [batch.slice(cut_at)]
            else:
                held.append(batch)
        if held:
            yield from found(pa.Table.from_batches(held))

    return packed.mapInArrow(run, "a long, b long, apart long, hidden boolean")


def _apart(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, apart) of the pairs that sketches do not rule out."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), *[F.col(x).alias(f"{x}_{s}") for x in SKETCH])
    apart = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in SKETCH), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    least = F.floor((total * OVER + (OVER + UNDER - 1)) / (OVER + UNDER))
    met = pairs.distinct().join(side("a"), "a").join(side("b"), "b").withColumn("apart", apart.cast("long"))
    return met.filter(F.col("apart") <= total - 2 * least).select("a", "b", "apart")


def _open_blocks(heavy: DataFrame, label: DataFrame, once: bool) -> DataFrame | None:
    """(key, i, j, side, node, label): the blocks of long lists with several labels that must meet. Lists inside another one are
    left out; blocks follow each other by size, and two meet only if their sizes and labels allow a link. With once, a set is only in the first
    of its lists."""
    named = heavy.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = cut(named, "labelled")
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    open_ = named.join(mixed, "key", "left_semi").withColumn("prior", F.lag("key").over(Window.partitionBy("node").orderBy("p")))
    open_ = cut(open_, "open")
    # All of a list's sets that also share one earlier n-gram meet in that list.
    inside = open_.groupBy("key").agg(F.count("*").alias("all"), F.count("prior").alias("prior"), F.min("prior").alias("x"), F.max("prior").alias("y"))
    outer = open_.join(inside.filter("all = prior and x = y").select("key"), "key", "left_anti")
    if outer.limit(1).count() == 0:
        return None
    if once:
        outer = top_rows(outer, ["node"], ["p"], 1)
    placed = spread_rows(outer.select("key", "node", "n", "label"), ["key"], ["n", "node"], "rn")
    placed = cut(placed.withColumn("block", F.floor((F.col("rn") - 1) / BLOCK)).drop("rn"), "blocks")
    spans = placed.groupBy("key", "block").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("n", "label") for f in (F.min, F.max)])
    side = lambda s: spans.select("key", *[F.col(c).alias(f"{c}_{s}") for c in spans.columns if c != "key"])
    one_label = (F.col("min_label_i") == F.col("max_label_j")) & (F.col("max_label_i") == F.col("min_label_j"))
    meets = (F.col("block_i") <= F.col("block_j")) & (F.col("max_n_i") * UNDER >= F.col("min_n_j") * OVER) & ~one_label
    met = cut(side("i").join(side("j"), "key").filter(meets).select("key", F.col("block_i").alias("i"), F.col("block_j").alias("j")), "meets")
    take = lambda s, at, more: placed.withColumnRenamed("block", s).join(met, ["key", s]).filter(more).select("key", "i", "j", F.lit(at).alias("side"), "node", "label")
    # A block that meets itself is there once, with a side of its own for every set.
    alone = take("i", 0, F.col("i") == F.col("j")).withColumn("side", F.col("node"))
    two = take("i", 0, F.col("i") < F.col("j")).unionByName(take("j", 1, F.col("i") < F.col("j")))
    return alone.unionByName(two.withColumn("side", F.col("side").cast("long")))


def _relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, label) with the groups that further links connect merged; only labels that a link joins take part in rounds."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = cut(label.unionByName(ends.join(label, "node", "left_anti").select("node", F.col("node").alias("label"))), "label")
    at = lambda s: every.select(F.col("node").alias(s), F.col("label").alias(f"{s}_label"))
    joined = links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).filter("a <> b")
    top = components(joined).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return cut(every.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "label")


def _meet(heavy: DataFrame, label: DataFrame, nodes: DataFrame, paths: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """label with the groups merged that long lists link. Rounds: the closest candidates of each set and of two groups are verified and
    groups merged, so that a group of near copies does not make all its pairs; each round allows more, until none is hidden."""
    tried, first, once = None, 2, True
    while True:
        blocks = _open_blocks(heavy, label, once)
        if blocks is None:
            return label
        found = cut(_joined(blocks.select("key", "i", "j", "side", "node", "label"), paths, ["key", "i", "j"], first), "found")
        fresh = found.select("a", "b").distinct()
        fresh = cut(fresh.join(tried, ["a", "b"], "left_anti") if tried is not None else fresh, "fresh")
        if fresh.limit(1).count():
            links = _verified(fresh, nodes, rows, width)
            label = _relabelled(label, links) if links.limit(1).count() else label
        if not once and found.filter("hidden").limit(1).count() == 0:
            return label
        tried, first, once = tried.unionByName(fresh) if tried is not None else fresh, first if once else first * 8, False


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the number of distinct n-grams of its words, and the smallest id reachable
    over links, its own included. Two texts link if the Jaccard similarity of their sets is 0.8 or more.

    A-Z are lower-cased, words stand between ASCII white space; a text of fewer words than width has one n-gram, its words. Null,
    empty and wordless texts have none and link with nothing: their component is their own id. Null ids never name a component that
    has another id. Repeated rows are kept; an empty table gives no rows. N-grams are compared as 64-bit hashes.

    All sets are in one global order of n-grams, rare ones first. Equal sets are one node, so copies make no pairs. Similar sets
    share one of their first fifth (the prefix), so each meets others in the lists of its prefix n-grams. Lists of up to LIGHT sets
    that have the same first set make one prefix tree, in which overlaps of shared beginnings are counted once and branches are left
    by the n-grams that remain. In longer lists all sets meet the LEADERS; then only lists with sets of several groups go on, in
    blocks by size, one tree per two blocks, in rounds. Closest candidates are verified first; others only if still in another group.
    Every candidate that can change a group is verified on the whole sets.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("row"))
    rank = docs.sparkSession.sparkContext.broadcast(_order(rows, width))

    def made(texts: list) -> list[pa.Array]:
        keys = [np.sort((rank.value[(h >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | (h & LOW)) for h in (shingles(t, width) for t in texts)]
        n = [len(k) for k in keys]
        odd = np.array([np.bincount((k & np.uint64(64 * WIDE - 1)).astype(np.int64), minlength=64 * WIDE) & 1 for k in keys], np.uint8)
        bits = np.packbits(odd.reshape(len(keys), 64 * WIDE), axis=1, bitorder="little").view(np.int64)
        wider = [np.packbits(np.bincount((k & np.uint64(WIDER - 1)).astype(np.int64), minlength=WIDER).astype(np.uint8) & 1).tobytes() for k in keys]
        node = np.array([xxhash.xxh64_intdigest(k.tobytes()) for k in keys], np.uint64).view(np.int64)
        first = _lists([k[: len(k) - (len(k) * OVER + UNDER - 1) // UNDER + 1] for k in keys])
        return [pa.array(node), pa.array(n, pa.int64()), first, pa.array(wider, pa.binary()), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(WIDE)]]

    added = "node long, n long, prefix array<long>, wider binary, " + ", ".join(f"{s} long" for s in SKETCH)
    prints = cut(_mapped(rows, made, added).withColumn("place", F.monotonically_increasing_id()), "prints")
    heads = cut(prints.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("place").alias("place")), "heads")
    nodes = cut(prints.join(heads.select("place"), "place", "left_semi").drop("doc_id", "place"), "nodes")

    entries = nodes.select("node", "n", F.posexplode("prefix").alias("p", "key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    listed = cut(entries.join(sizes, "key"), "lists")
    light, heavy = (listed.filter(c).drop("size") for c in (F.col("size") <= LIGHT, F.col("size") > LIGHT))
    anchor = light.groupBy("key").agg(F.min(F.struct("node", "p")).alias("at"))
    groups = light.join(anchor, "key").select(F.col("at.node").alias("anchor"), F.floor(F.col("at.p") / CHUNK).alias("part"), "node").distinct()
    path = listed.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "key"))), lambda x: x["key"]).alias("path"))
    paths = cut(nodes.join(path, "node").select("node", "n", "path", "wider", *SKETCH), "paths")
    candidates = _joined(groups, paths, ["anchor", "part"]).drop("hidden")
    some = heavy.limit(1).count() > 0
    if some:
        lead = top_rows(heavy, ["key"], ["node"], LEADERS)
        candidates = candidates.unionByName(_apart(_pairs(lead, heavy, F.lit(True)), nodes))
    candidates = cut(candidates.distinct(), "candidates")
    links = _verified(top_rows(candidates, ["b"], ["apart", "a"], 1).select("a", "b"), nodes, rows, width)
    label = cut(components(links), "label")
    named = lambda s: label.select(F.col("node").alias(s), F.col("label").alias(f"{s}_label"))
    apart: Column = F.coalesce("a_label", "a") != F.coalesce("b_label", "b")
    more = candidates.join(named("a"), "a", "left").join(named("b"), "b", "left").filter(apart).select("a", "b")
    label = _relabelled(label, _verified(more, nodes, rows, width))
    if some:
        label = _meet(heavy, label, nodes, paths, rows, width)

    grouped = heads.select("node", "first").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    where = cut(grouped.join(smallest, "label").select(F.col("node"), "component_id"), "groups")
    discard(nodes, listed, paths, candidates)
    full = prints.select("doc_id", "n", "node").filter("n > 0").join(where, "node").select("doc_id", "n", "component_id")
    none = prints.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.unionByName(none).select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")
