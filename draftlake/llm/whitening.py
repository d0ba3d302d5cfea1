"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows stay where they are: a step is one job in which every task multiplies its centred rows by one short vector (Xv),
and multiplies the outcome back (X'u); only sums about as long as two rows leave a task. The left vectors u are linear in the rows,
u = Xg, so the driver keeps their short g and no task keeps state: a lost executor costs its tasks and nothing more. Right
and left vectors are reorthogonalised in full. After as many steps as a row has entries the small bidiagonal matrix has the
same singular values as the rows; its singular vectors give the components, its singular values the deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.session import cut

STEP, SHIFT = 64, 1_000_000   # an entry c counts as floor(STEP * c) + SHIFT
COMPONENTS = 32
ROWS = 4_096                  # rows that a task multiplies at once
TASKS = 4_096                 # tasks of a step at most; each sends the driver one sum as long as two rows
ZERO = 1e-10                  # a deviation below this share of the largest counts as none
SEED = 11


def fit_list(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>): rows whose vector is there and has only finite entries.

    Repeated rows and null keys stay. Vectors of another length than most (ties: the longer one) are left out, empty
    vectors and entries whose number does not fit a long as well.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda c: F.floor(STEP * c.cast("double")) + SHIFT).alias("x"), F.col(vector).alias("c"))
    finite = "size(c) > 0 and forall(c, e -> e is not null and not isnan(e) and abs(double(e)) < 1e17)"
    return rows.where("c is not null").where(finite).select("vec_id", "x")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            yield part.column(0), flat.reshape(part.num_rows, -1)


def _totals(rows: DataFrame, measure: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum of ``measure`` over blocks of rows; every task adds up its own, the driver gets at most ``TASKS`` sums. Empty without rows."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, block in _blocks(batches):
            own = measure(block)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["sums"])

    found = rows.coalesce(TASKS).mapInArrow(added, f"sums array<{kind}>").toArrow().column("sums").combine_chunks()
    return found.flatten().to_numpy().reshape(len(found), -1).sum(axis=0) if len(found) else np.zeros(0)


@dataclass
class Whitening:
    """``components`` in columns, by falling ``eigenvalues``, of the covariance of ``n`` rows with sums ``sums``; ``explained`` are shares of the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def centred(self, block: np.ndarray) -> np.ndarray:
        return centre(block, self.n, self.sums)

    def apply(self, block: np.ndarray) -> np.ndarray:
        return self.centred(block) @ self.components / np.sqrt(self.eigenvalues)


def centre(block: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from whole numbers, so nothing is lost against the large shift."""
    return (n * block - sums) / n


def bidiagonalise(rows: DataFrame, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): the centred rows X have XV = UB, with V orthogonal, the columns of U orthonormal and B upper bidiagonal.

    An invariant subspace (repeated or zero singular values) ends a chain; the next vector is then any one orthogonal to
    all before, and the coupling is zero. There are as many steps, and passes over the rows, as a row has entries.
    """
    d = len(sums)
    rng = np.random.default_rng(SEED)
    right = np.zeros((d, 0))       # V
    left = np.zeros((d, 0))        # G: U = XG
    back = np.zeros((d, 0))        # X'U
    small = np.zeros((d, d))
    v, beta, scale = rng.normal(size=d), 0.0, 0.0
    v /= np.linalg.norm(v)
    for k in range(d):
        aim = v - beta * left[:, -1] if k else v

        def products(block: np.ndarray, aim=aim, left=left) -> np.ndarray:
            x = centre(block, n, sums)
            s = x @ aim
            return np.concatenate([(x @ left).T @ s, [s @ s], x.T @ s])

        found = _totals(rows, products)
        overlap, square, w = found[:k], found[k], found[k + 1 :]
        alpha = np.sqrt(max(square - overlap @ overlap, 0.0))
        scale = max(scale, alpha, beta)
        right = np.column_stack([right, v])
        if alpha <= 1e-13 * scale:
            alpha, g, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            g, z = (aim - left @ overlap) / alpha, (w - back @ overlap) / alpha
        left, back = np.column_stack([left, g]), np.column_stack([back, z])
        small[k, k] = alpha
        if k + 1 == d:
            break
        v = z - alpha * v
        for _ in range(2):
            v -= right @ (right.T @ v)
        beta = np.linalg.norm(v)
        if beta <= 1e-13 * scale:
            beta, v = 0.0, rng.normal(size=d)
            for _ in range(3):
                v -= right @ (right.T @ v)
                v /= np.linalg.norm(v)
        else:
            v /= beta
            # Entries lost to rounding in the division are taken out again.
            v -= right @ (right.T @ v)
            v /= np.linalg.norm(v)
        small[k, k + 1] = beta
    return right, small


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The first ``most`` components of rows from ``fit_list``, all of one length; None if there are no rows.

    Components without any deviation are left out. Signs: the largest entry of a component is positive.
    """
    found = _totals(rows, lambda block: np.concatenate([[len(block)], block.sum(axis=0)]), "long")
    if not len(found):
        return None
    n, sums = int(found[0]), found[1:].astype(np.int64)
    right, small = bidiagonalise(rows, n, sums)
    _, deviations, turned = np.linalg.svd(small)
    eigenvalues = deviations**2 / n
    trace = eigenvalues.sum()
    kept = np.flatnonzero(deviations > ZERO * deviations[0])[:most] if trace > 0 else np.zeros(0, int)
    components = (right @ turned.T)[:, kept]
    components /= np.linalg.norm(components, axis=0)
    if len(kept):
        components *= np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(kept))])
    return Whitening(n, sums, components, eigenvalues[kept], eigenvalues[kept] / trace if trace > 0 else eigenvalues[kept])


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k = len(model.eigenvalues)

    def moments(block: np.ndarray) -> np.ndarray:
        w = model.apply(block)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = _totals(rows, moments) / model.n
    mean, square = found[:k], found[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component.

    deviation is the exact sum over the entries of (n*x - S)^2, null where a long cannot hold it. Repeated rows have rows
    each; a null vec_id stays null; other columns are not read. An empty table, and vectors that are all equal, give no
    rows. Vectors may be long; one row is in one task as a whole, and the driver holds a square of its length.
    """
    rows = cut(fit_list(vectors, key, vector))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    rows = rows.where(F.size("x") == lengths[0]["d"])
    model = fit(rows, most)
    k = len(model.eigenvalues)
    if not k:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(rows, model)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _blocks(batches):
            m = len(block)
            away = model.n * block - model.sums
            squares = (away * away).sum(axis=1)
            too_large = (away.astype(float) ** 2).sum(axis=1) > 9e18
            repeat = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array(squares[repeat], mask=too_large[repeat]), pa.array(model.apply(block).ravel()),
                pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(whitened, SCHEMA)
