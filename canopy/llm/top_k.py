"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.ordering import top_rows
from canopy.session import run_dir

BLOCK = 4096        # queries that are broadcast at once
ROWS = 2048         # candidates scored at once
BINS = 256          # parts into which a pass divides the range that holds the k-th score
EXACT = 2 ** 53     # below this, float products and sums of integers are exact
LONG = (-(2 ** 63), 2 ** 63 - 1)


def _by_length(ids: np.ndarray, vectors: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, integer components) of the valid vectors, by vector length; sorted by id."""
    lengths = np.asarray([-1 if n is None else n for n in pc.list_value_length(vectors).to_pylist()])
    flat = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    out = {}
    for n in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == n)
        m = flat[starts[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0))
        fine = np.isfinite(m).all(axis=1)
        at, m = at[fine], m[fine]
        order = np.argsort(ids[at], kind="stable")
        out[n] = (ids[at][order], np.floor(m[order] * scale))
    return out


class Block:
    """A block of queries and, per query, the range of integers in which its k-th score lies."""

    def __init__(self, rows: list, scale: int, k: int):
        ids = np.asarray([r[0] for r in rows], np.int64)
        self.k, self.scale = k, scale
        self.groups = {n: g for n, g in _by_length(ids, pa.array([r[1] for r in rows], pa.list_(pa.float64())), scale).items() if len(g[0])}
        self.ids = np.concatenate([g[0] for g in self.groups.values()]) if self.groups else np.zeros(0, np.int64)
        self.first = dict(zip(self.groups, np.cumsum([0, *(len(g[0]) for g in self.groups.values())])[:-1].tolist()))

    def start(self, largest: float) -> None:
        """Ranges from the largest length of any vector: an inner product is at most the product of the lengths."""
        norms = np.concatenate([np.sqrt((g[1] ** 2).sum(axis=1)) for g in self.groups.values()])
        self.big = bool((norms * largest).max(initial=0) * 1.001 >= EXACT / 4)
        bounds = [int(x) + 2 for x in (norms * largest * 1.001).tolist()]
        self.lo = np.array([-b for b in bounds], dtype=object if self.big else np.int64)
        self.hi = np.array(bounds, dtype=object if self.big else np.int64)
        self.above = np.zeros(len(bounds), np.int64)
        self.few = np.zeros(len(bounds), bool)  # fewer than k candidates: all are taken

    def width(self) -> np.ndarray:
        return (self.hi - self.lo) // BINS + 1

    def open(self) -> bool:
        return bool((~self.few & (self.hi > self.lo)).any())

    def scores(self, ids: np.ndarray, vectors: pa.Array):
        """(first query, candidate ids, scores as candidates x queries, true where it counts) for each vector length."""
        for n, (own, m) in _by_length(ids, vectors, self.scale).items():
            if n in self.groups and len(own):
                q_ids, q = self.groups[n]
                if self.big:
                    exact = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)
                    s = np.clip(exact(m).dot(exact(q).T), *LONG) if n else np.zeros((len(m), len(q)), object)
                else:
                    s = (m @ q.T).astype(np.int64)
                yield self.first[n], own, s, own[:, None] != q_ids[None, :]


def _batches(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            fine = part.filter(pc.is_valid(part.column(0)))
            yield fine.column(0).to_numpy(zero_copy_only=False).astype(np.int64), fine.column(1)


def _histogram(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = shared.value
        width, n = b.width(), len(b.ids)
        tally = np.zeros(n * BINS, np.int64)
        for ids, vectors in _batches(batches):
            for first, _, s, fine in b.scores(ids, vectors):
                q = slice(first, first + s.shape[1])
                fine &= ((s >= b.lo[q]) & (s <= b.hi[q])).astype(bool)
                cells = ((s - b.lo[q]) // width[q] + np.arange(first, q.stop) * BINS)[fine].astype(np.int64)
                tally += np.bincount(cells, minlength=n * BINS)
        tally = tally.reshape(n, BINS)
        higher = tally[:, ::-1].cumsum(axis=1)[:, ::-1] - tally  # below k scores of this task alone, no bin can matter
        at = np.nonzero((tally > 0) & (higher < (b.k - b.above)[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(tally[at])], ["q", "bin", "n"])
    return run


def _select(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = shared.value
        for ids, vectors in _batches(batches):
            for first, own, s, fine in b.scores(ids, vectors):
                q = slice(first, first + s.shape[1])
                over = fine & (b.few[q] | (s > b.hi[q])).astype(bool)
                tie = fine & ~over & (s == b.hi[q]).astype(bool)
                tie &= tie.cumsum(axis=0) <= b.k - b.above[q]  # ids ascend: a batch needs no later ties
                r, c = np.nonzero(over | tie)
                found = [pa.array(b.ids[c + first]), pa.array(own[r]), pa.array(s[r, c].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(found, ["query_id", "vec_id", "score"])
    return run


def _blocks(queries: DataFrame, size: int):
    rows = []
    for r in queries.toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = BLOCK, vec_id: str = "vec_id",
                vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query with all other rows.

    Components become floor(scale * x). Ties go to the smaller id; a query with fewer than k candidates gets them all.
    Rows whose vector is null or has null or non-finite components, and rows without id, take no part; a pair of
    different lengths has no product. Components may reach 1e100. Rows with the query's id are its own; a candidate row that is repeated counts as
    often, a repeated query row once (the first by content). Scores beyond a long count as its bounds.

    Queries come in blocks of bounded size, broadcast in turn. Passes over all candidates count each query's scores in
    bins of the range that holds its k-th score, the driver narrows the ranges by the summed counts (at most k bins per
    task and query travel), until each range is one integer; a last pass keeps what lies above and the first ties.
    """
    spark = vectors.sparkSession
    table = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null")
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    at_most = lambda x: F.abs(x) * F.lit(float(scale)) + F.lit(1.0)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + at_most(x) * at_most(x)))
    largest = table.filter(usable).agg(F.max(length)).first()[0] or 0.0
    asked = vectors.filter(is_query).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = asked.filter("id is not null").filter(usable).groupBy("id").agg(F.min("v").alias("v"))
    out = run_dir(spark, "top-k")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for rows in _blocks(asked, block):
        b = Block(rows, scale, k)
        b.start(largest)
        while b.open():
            shared = spark.sparkContext.broadcast(b)
            found = table.mapInArrow(_histogram(shared), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            bins: dict[int, list] = {}
            for q, at, n in found.collect():
                bins.setdefault(q, []).append((at, n))
            width = b.width()
            for q in np.flatnonzero(~b.few & (b.hi > b.lo)).tolist():
                need = b.k - b.above[q]
                for at, n in sorted(bins.get(q, []), reverse=True):
                    if n >= need:
                        break
                    need -= n
                else:
                    b.few[q] = True
                    continue
                low = b.lo[q] + at * width[q]
                b.above[q], b.hi[q], b.lo[q] = b.k - need, min(low + width[q] - 1, b.hi[q]), low
            shared.unpersist()
        shared = spark.sparkContext.broadcast(b)
        chosen = table.mapInArrow(_select(shared), "query_id long, vec_id long, score long")
        best = top_rows(chosen, ["query_id"], [F.desc("score"), F.col("vec_id")], k, "rank")
        best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
