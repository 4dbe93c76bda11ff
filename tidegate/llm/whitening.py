"""Embedding whitening by matrix-free block subspace iteration.

The covariance V of the vectors is never formed. A pass over the rows gives V Q for a narrow block Q of orthonormal columns; the
driver, which holds blocks of the vectors' dimension and never rows, turns that into Ritz pairs and residuals.
Passes end when the residuals of all wanted components are as small as rounding lets them be. Where they shrink too slowly, as with
eigenvalues that lie close together, the block is widened, up to the whole dimension, where one pass is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this count as this, so that they stay whole numbers.
LARGEST = 1 << 53
#: A residual, as a share of the largest eigenvalue, at which a component is certified.
TOLERANCE = 1e-13
#: Columns of the first block beyond the components, passes that may be left before the block is widened, and what rank ends at.
BESIDE, PASSES_LEFT, RANK = 16, 4, 1e-12
#: Blocks added up in one step.
FAN_IN = 128
_SQUARES = 9.0e18


def _valid(column: pa.Array, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has d entries, all finite, and these vectors as whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
    rows = np.flatnonzero(lengths == d)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[column.offsets.to_numpy()[rows][:, None] + np.arange(d)]
    ok = np.isfinite(x).all(axis=1)
    return rows[ok], np.clip(np.floor(SCALE * x[ok]), -LARGEST, LARGEST).astype(np.int64) + SHIFT


@dataclass
class Fit:
    """What the passes know: dimension, rows, sums of the whole numbers, eigenvalues and vectors, trace."""

    d: int
    n: int
    sums: list[int]
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None
    trace: float = 0.0
    passes: int = 0
    residual: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)² over the dimensions, exact; None where it doesn't fit a long."""
        s = np.array(self.sums, object)
        near = (self.n * self.centred(x)) ** 2
        if not len(x) or max(near.sum(axis=1).max(), 1.0 * self.n * np.abs(x).max()) < _SQUARES:
            return (((self.n * x - s.astype(np.int64)) ** 2).sum(axis=1)).tolist()
        exact = [int(((self.n * r.astype(object) - s) ** 2).sum()) for r in x]
        return [v if v < 1 << 63 else None for v in exact]


def _total(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], d: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``of(x)`` over all Arrow batches. Each task sends one block; they are added up in a tree, FAN_IN at a time."""
    tasks = rows.rdd.getNumPartitions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            x = _valid(batch.column("v"), d)[1]
            if len(x):
                total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["task", "block"])

    def added(t: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        order = np.argsort(t.column("task").to_numpy())
        for i in order:  # in one order, so that reruns agree
            total += np.frombuffer(t.column("block")[int(i)].as_py()).reshape(shape)
        return pa.table({"task": pa.array([int(t.column("task").to_numpy().min())], pa.int64()), "block": pa.array([total.tobytes()], pa.binary())})

    parts, step = rows.mapInArrow(run, "task long, block binary"), FAN_IN
    while True:
        parts = parts.groupBy(F.floor(F.col("task") / step).cast("long").alias("node")).applyInArrow(added, "task long, block binary")
        if step >= tasks:
            break
        step *= FAN_IN
    found = parts.collect()
    return np.frombuffer(found[0].block).reshape(shape) if found else np.zeros(shape)


def _counted(rows: DataFrame) -> tuple[int, int] | None:
    """The dimension that most finite vectors have, of equals the larger, and how many have it."""
    inf = float("inf")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf)))
    sizes = rows.where(F.col("v").isNotNull() & finite).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.where("d > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return (top[0].d, top[0].n) if top else None


def _summed(rows: DataFrame, d: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, np.int64)
        for batch in batches:
            total += _valid(batch.column("v"), d)[1].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total)], names=["i", "s"])

    found = rows.mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [0] * d
    for r in found:
        sums[r.i] = int(r.s)
    return sums


def fitted(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, tolerance: float = TOLERANCE) -> Fit | None:
    """Mean and leading eigenpairs of the vectors' covariance; None without any vector.

    The driver holds blocks of d x b doubles, b at most d: 2 MB for 512 dimensions in full.
    """
    rows = df.select(F.col(vector).alias("v"))
    if (counted := _counted(rows)) is None:
        return None
    d, n = counted
    fit = Fit(d, n, _summed(rows, d))
    k = min(components, d)
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((d, min(d, k + BESIDE))))[0]
    before = None
    while True:
        b = q.shape[1]

        def product(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            c = fit.centred(x)
            return np.vstack([c.T @ (c @ q), np.full((1, q.shape[1]), (c * c).sum())])

        total = _total(rows, product, d, (d + 1, b)) / n
        z, fit.trace = total[:-1], float(total[-1, 0])
        fit.passes += 1
        h = q.T @ z
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, image = q @ y, z @ y
        top = max(theta[0], np.finfo(float).tiny)
        # an eigenvalue that is nothing beside the largest has no direction to certify
        wanted = [i for i in range(k) if theta[i] > RANK * top]
        residual = max((np.linalg.norm(image[:, i] - theta[i] * ritz[:, i]) for i in wanted), default=0.0) / top
        fit.residual = residual
        if residual <= tolerance or b == d:
            break
        rate = residual / before if before else 1.0
        left = np.log(tolerance / residual) / np.log(rate) if rate < 1 else np.inf
        before = residual
        q = image
        if left > PASSES_LEFT:
            q, before = np.hstack([image, top * rng.standard_normal((d, min(d, 2 * b) - b))]), None
        q = np.linalg.qr(q)[0]
    fit.values, fit.vectors = theta[wanted], np.linalg.qr(ritz[:, wanted])[0] if wanted else ritz[:, :0]
    return fit


def identity_error(df: DataFrame, fit: Fit, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from a pass over all rows."""
    k = len(fit.values)

    def product(x: np.ndarray) -> np.ndarray:
        w = fit.whitened(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _total(df.select(F.col(vector).alias("v")), product, fit.d, (k + 1, k)) / fit.n
    # rows are centred already: what is left of a mean is rounding
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(k)).max())


def whitened(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, fit: Fit | None = None) -> DataFrame:
    """For each finite vector and component: the id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained,
    identity_error.

    Entries c become floor(1024 c) + 100000, so that counts, sums and deviations are exact; entries beyond 2^53 count as that.
    Null vectors, empty ones and those with null or non-finite entries are left out, and so are vectors of another length than
    most have (of equally frequent lengths the larger stays): no covariance holds both. Repeated rows and ids count as often as they
    stand there; null ids give rows. A component without variance has no whitened value and gives no rows, so one vector,
    or equal ones, give none. A deviation that no long holds is null. An empty table gives an empty table.
    """
    schema = df.select(F.col(id)).schema
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")):
        schema = schema.add(name, kind)
    fit = fit or fitted(df, vector, components)
    if fit is None or not len(fit.values):
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(df, fit, vector), len(fit.values)
    explained = fit.values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _valid(batch.column("v"), fit.d)
            if not len(rows):
                continue
            deviation, m = pa.array(fit.deviations(x), pa.int64()), len(rows)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)), deviation.take(pa.array(each)),
                 pa.array(fit.whitened(x).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=schema.names,
            )

    return df.select(F.col(id).alias("id"), F.col(vector).alias("v")).mapInArrow(run, schema)
