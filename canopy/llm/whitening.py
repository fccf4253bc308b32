"""Whitening of embeddings by shifted CholeskyQR: Gram passes over the centred rows, triangular solves, one SVD of R."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000   # an entry c counts as floor(SCALE * c) + SHIFT
LARGEST = 2.0 ** 52            # entries beyond it count as it, before the shift
COMPONENTS = 8
ROWS = 4096                    # rows that a task turns into a matrix at once
DIMS = 4096                    # most dimensions: the driver holds a few square matrices of them
SPLIT = 26                     # low bits of an entry that are summed apart, so that long sums stay exact
FAINT = 2.0 ** -40             # share of the largest singular value at which a direction counts as rounding
PASSES = 12                    # Gram passes at most; three are usual
GOOD = 1e-12                   # largest entry of the Gram matrix minus the identity that ends the passes


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Entries as whole numbers: one row per vector."""
    flat = pc.fill_null(vectors.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return (np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT).reshape(-1, dims)


def _parts(batches: Iterator[pa.RecordBatch], dims: int):
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            if part.num_rows:
                yield part, _matrix(part.column(part.num_columns - 1), dims)


class Centre:
    """Rows minus their mean: (n * x - S) / n, with an exact numerator."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int]):
        self.n, self.sums = n, sums
        most = max(max(abs(n * x - s) for x, s in zip(ends, sums)) for ends in (low, high))
        self.small = most < 2 ** 62 and n * max(map(abs, [*low, *high])) < 2 ** 62
        self.exact = self.small and len(sums) * most * most < 2 ** 63   # deviations fit into a long

    def wide(self, x: np.ndarray) -> np.ndarray:
        if self.small:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def centred(self, wide: np.ndarray) -> np.ndarray:
        return wide.astype(np.float64) / self.n

    def deviations(self, wide: np.ndarray) -> list:
        if self.exact:
            return (wide * wide).sum(axis=1).tolist()
        each = wide.astype(object)
        return [x if x < 2 ** 63 else None for x in (each * each).sum(axis=1)]


def _sum_pass(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _parts(batches, dims):
            got = [np.arange(dims), (x >> SPLIT).sum(axis=0), (x & (2 ** SPLIT - 1)).sum(axis=0), x.min(axis=0), x.max(axis=0), np.full(dims, len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in got], ["dim", "high", "low", "least", "most", "n"])
    return run


def _gram_pass(shared, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, solve, shift = shared.value
        k = solve.shape[1]
        total, sums = np.zeros((k, k)), np.zeros(k)
        for _, x in _parts(batches, dims):
            q = centre.centred(centre.wide(x)) @ solve - shift
            total += q.T @ q
            sums += q.sum(axis=0)
        at = np.triu_indices(k)
        cells = np.concatenate([at[0] * k + at[1], k * k + np.arange(k)])
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(np.concatenate([total[at], sums]))], ["cell", "v"])
    return run


def _gram(table: DataFrame, centre: Centre, solve: np.ndarray, shift: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(Gram matrix, column sums) of centred rows times solve, minus shift; every task sends one triangle."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast((centre, solve, shift))
    k = solve.shape[1]
    found = table.select("v").mapInArrow(_gram_pass(shared, dims), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    shared.unpersist()
    flat = np.zeros(k * k + k)
    flat[found.column(0).to_numpy()] = found.column(1).to_numpy()
    g = flat[: k * k].reshape(k, k)
    return np.triu(g) + np.triu(g, 1).T, flat[k * k :]


def triangular_solve(r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with r x = b, r upper triangular, by back substitution."""
    x = np.array(b, np.float64)
    for i in range(len(r) - 1, -1, -1):
        x[i] = (x[i] - r[i, i + 1 :] @ x[i + 1 :]) / r[i, i]
    return x


def _cholesky(g: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper R with R'R = g. The first pass adds the shift 11 (n d + d (d + 1)) u |g|, under which the factor exists however
    ill-conditioned the rows are; later ones only if they need it."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * 2.0 ** -53 * np.linalg.norm(g, 2)
    for s in ([] if first else [0.0]) + [shift * 10.0 ** i for i in range(16)]:
        try:
            return np.linalg.cholesky(g + s * np.eye(d)).T
        except np.linalg.LinAlgError:
            continue
    raise ValueError("no Cholesky factor")


def fit(table: DataFrame, dims: int) -> tuple[Centre, np.ndarray, np.ndarray, float, int]:
    """(centre, components as columns, eigenvalues, trace, passes) of the covariance of table's vectors v, all of dims
    entries; components without variance are left out."""
    sums = table.select("v").mapInArrow(_sum_pass(dims), "dim long, high long, low long, least long, most long, n long").groupBy("dim").agg(
        F.sum(F.col("high").cast("decimal(38,0)")), F.sum(F.col("low").cast("decimal(38,0)")), F.min("least"), F.max("most"), F.sum("n")).collect()
    sums.sort()
    n = int(sums[0][5])
    centre = Centre(n, [(int(r[1]) << SPLIT) + int(r[2]) for r in sums], [int(r[3]) for r in sums], [int(r[4]) for r in sums])
    still = np.zeros(dims)
    g, _ = _gram(table, centre, np.eye(dims), still, dims)
    trace = float(np.trace(g))
    basis = np.eye(dims)[:, np.diag(g) > 0]   # constant dimensions have no part in any component
    if not basis.shape[1]:
        return centre, np.zeros((dims, 0)), np.zeros(0), 0.0, 1
    g, r, passes = basis.T @ g @ basis, np.eye(basis.shape[1]), 1
    while True:
        r = _cholesky(g, n, passes == 1) @ r
        _, sigma, vt = np.linalg.svd(r)
        fine = sigma > sigma[0] * FAINT
        if not fine.all():   # directions that only rounding fills: go on in what remains
            basis, r = basis @ vt[fine].T, np.diag(sigma[fine])
        g, _ = _gram(table, centre, basis @ triangular_solve(r, np.eye(len(r))), np.zeros(len(r)), dims)
        passes += 1
        if np.abs(g - np.eye(len(r))).max() <= GOOD or passes >= PASSES:
            break
    _, sigma, vt = np.linalg.svd(_cholesky(g, n, False) @ r)
    return centre, basis @ vt.T, sigma ** 2 / n, trace / n, passes


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue, passes) of every usable row and
    of the first components; one row each.

    An entry c counts as x = floor(1024 c) + 100000. n vectors are fitted, with sums S; deviation is the exact sum of
    (n x - S)^2 (null if no long holds it), whitened the row minus the mean on the component, a unit eigenvector of the
    covariance (divisor n), over the root of its eigenvalue. Components fall by eigenvalue; those without variance are left out.
    identity_error is the largest entry of the whitened columns' covariance minus the identity, measured by one more pass.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do those of another length than
    the most frequent (of equally frequent ones the largest). Repeated rows and null ids are rows like any other; |1024 c| beyond
    2^52 counts as that. Equal vectors throughout, or an empty table, give no rows.

    The first Gram pass, shifted, gives R1; then rows are solved against R and their Gram matrix gives the next factor, until it
    is the identity. R = ... R2 R1 is decomposed on the driver, which holds matrices of dimensions, never rows. Every task sends
    one triangle, summed by a shuffle over its cells.
    """
    spark = rows.sparkSession
    table = rows.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    table = table.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    lengths = table.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    kind = dict(rows.dtypes)[vec_id]
    schema = f"`{vec_id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, passes int"
    if not lengths:
        return spark.createDataFrame([], schema)
    dims = lengths[0][0]
    if dims > DIMS:
        raise ValueError(f"vectors of {dims} entries; {DIMS} are allowed")
    table = table.filter(F.size("v") == dims)
    centre, axes, values, trace, passes = fit(table, dims)
    k = min(components, len(values))
    if not k:
        return spark.createDataFrame([], schema)
    solve = axes[:, :k] / np.sqrt(values[:k])
    _, sums = _gram(table, centre, solve, np.zeros(k), dims)
    g, _ = _gram(table, centre, solve, sums / centre.n, dims)
    error = float(np.abs(g / centre.n - np.eye(k)).max())
    shared = spark.sparkContext.broadcast((centre, solve))
    explained, eigen = values[:k] / trace, values[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, solve = shared.value
        for part, x in _parts(batches, dims):
            wide, m = centre.wide(x), len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            column = lambda v, t: pa.array(np.tile(v, m), t)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(at), column(np.arange(1, k + 1), pa.int32()), pa.array(np.full(m * k, centre.n), pa.int64()),
                pa.array(centre.deviations(wide), pa.int64()).take(at), pa.array((centre.centred(wide) @ solve).ravel()), column(explained, pa.float64()),
                pa.array(np.full(m * k, error)), column(eigen, pa.float64()), pa.array(np.full(m * k, passes), pa.int32())],
                [vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue", "passes"])

    return table.mapInArrow(run, schema)
