"""Merkle manifest of a dataset: leaf digests, one tree per group, one tree over the groups, a proof for every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.ordering import spread_rows
from canopy.session import cut

FANOUT = 16   # consecutive nodes that make one parent
STEP = "array<struct<left:string,right:string>>"


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values, one after the other: `-` for null, else the UTF-8 byte count, `:` and the value
    as text."""
    coded = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*coded), 256)


def fold(leaf: Column, path: Column) -> Column:
    """Root that a leaf leads to by its siblings: at every step the digest of left siblings, node and right siblings."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right; of nothing where there are none."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes (tree, pos, node, ...) with run and slot (its place), left and right (digests of the run's other nodes in order,
    as one text) and alone (its tree has no other node at this level)."""
    placed = nodes.withColumn("run", F.floor(F.col("pos") / fanout)).withColumn("slot", F.pmod("pos", F.lit(fanout)))
    by = Window.partitionBy("tree", "run")
    placed = placed.withColumn("length", F.count("*").over(by))
    order = by.orderBy("pos")
    slot, length = F.col("slot"), F.col("length")
    before = [F.when(slot >= k, F.lag("node", k).over(order)) for k in range(fanout - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("node", k).over(order)) for k in range(1, fanout)]
    text = lambda parts: F.concat(F.lit(""), *[F.coalesce(p, F.lit("")) for p in parts])
    near = placed.select(*placed.columns, text(before).alias("left"), text(after).alias("right"))
    return near.withColumn("alone", (F.col("pos") == 0) & (F.col("length") == 1))


def _climb(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels (tree, pos, node) of every tree from its leaves up, each written, and (tree, node) of what remains."""
    levels, tops = [leaves.select("tree", "pos", "node")], []
    while True:
        firsts = _with_siblings(levels[-1], fanout).filter("slot = 0")
        node = F.when(F.col("alone"), F.col("node")).otherwise(F.sha2(F.concat("node", "right"), 256))
        parents = cut(firsts.select("tree", F.col("run").alias("pos"), node.alias("node"), "alone"), "level")
        tops.append(parents.filter("alone").select("tree", "node"))
        if parents.filter("not alone").limit(1).count() == 0:
            return levels, reduce(DataFrame.unionByName, tops)
        levels.append(parents.filter("not alone").select("tree", "pos", "node"))


def _descend(levels: list[DataFrame], above: DataFrame, fanout: int, to: int) -> DataFrame:
    """(tree, pos, path, *rest) of the nodes of level to; above holds (tree, path, *rest) of what remains of every tree. A level
    is written before the next one reads it; rows of a level move once, by their run."""
    rest = [c for c in above.columns if c not in ("tree", "path")]
    up = None
    for i in range(len(levels) - 1, to - 1, -1):
        up = _paths(levels[i], up, above, rest, fanout, [])
        if i > to:
            up = cut(up, "paths")
    return up


def _paths(level: DataFrame, up: DataFrame | None, above: DataFrame, rest: list[str], fanout: int, keep: list[str]) -> DataFrame:
    near = _with_siblings(level, fanout)
    top = near.filter("alone").select("tree", "pos", *keep).join(above, "tree").select("tree", "pos", "path", *rest, *keep)
    if up is None:
        return top
    step = F.array(F.struct("left", "right")).cast(STEP)
    parents = up.select("tree", F.col("pos").alias("run"), F.col("path").alias("higher"), *rest)
    inner = near.filter("not alone").join(parents, ["tree", "run"])
    return inner.select("tree", "pos", F.concat(step, "higher").alias("path"), *rest, *keep).unionByName(top)


def manifest(rows: DataFrame, fields: list[str], group: str, key: str, carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(key, leaf, subroot, root, path, *carry) of every row.

    A leaf is leaf_digest of the fields. Per group, leaves ascend by key; while several nodes remain, every fanout consecutive
    ones (the last run may hold fewer, even one) become the digest of their concatenation. What remains is the group's
    subroot; subroots ordered by group (null first, then bytewise) make the root likewise. path lists, level by level, the
    digests left and right of the row's node, so that fold(leaf, path) is the root. carry names columns that are computed
    from a row and kept beside it, such as the leaf of a changed copy.

    Null keys come first, equal keys by their leaf; repeated rows are leaves of their own. Null fields and texts of any
    length have a digest each; null is a group. An empty table gives no rows. Other columns of rows are not touched.

    Positions come from range partitions, so no group is sorted in one task; siblings from lag and lead inside runs of
    fanout rows. Texts are read once. Levels shrink by fanout, and each is written to the shared folder.
    """
    named = {f"_c{i}": c for i, c in enumerate((carry or {}).values())}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), F.col(key).alias("key"), leaf_digest(*[F.col(f) for f in fields]).alias("node"),
                         *[c.alias(n) for n, c in named.items()], F.monotonically_increasing_id().alias("row"))
    leaves = cut(leaves, "leaves")
    placed = spread_rows(leaves, ["tree"], ["key", "node", "row"], "pos").drop("row")
    placed = cut(placed.withColumn("pos", F.col("pos") - 1), "placed")
    levels, subroots = _climb(placed, fanout)
    outer = spread_rows(subroots, [], ["tree"], "pos").select(F.lit("").alias("tree"), F.col("tree").alias("of"), (F.col("pos") - 1).alias("pos"), "node")
    outer = cut(outer, "subroots")
    top_levels, root = _climb(outer, fanout)
    whole = root.select("tree", F.array().cast(STEP).alias("path"), F.col("node").alias("root"))
    by_group = _descend(top_levels, whole, fanout, 0).join(outer.select("pos", "of", F.col("node").alias("subroot")), "pos")
    above = cut(by_group.select(F.col("of").alias("tree"), "path", "subroot", "root"), "above")
    rest = ["subroot", "root"]
    up = cut(_descend(levels, above, fanout, 1), "paths") if len(levels) > 1 else None
    found = _paths(placed, up, above, rest, fanout, ["key", "node", *named])
    out = [F.col(n).alias(name) for n, name in zip(named, carry or {})]
    return found.select(F.col("key").alias(key), F.col("node").alias("leaf"), *rest, "path", *out)
