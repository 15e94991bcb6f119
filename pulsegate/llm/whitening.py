"""Embedding whitening: components and deviations by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The fit list is each distinct vector of integers floor(256 c) + 0 once, in blocks on the shared folder. A
step is one pass over them: each task centres its rows, forms X q, lays the product against the left vectors
found so far and multiplies it back by the transposed rows; what comes to the driver is one number for each
dimension and step. Left vectors are as long as the fit list, so they are never stored: each lies in the
range of X, u = X a, and tasks rebuild it from the rows and its coefficients `a` (as many as there are
dimensions). Both sides are fully reorthogonalised, the right one twice. The singular value decomposition of
the small bidiagonal matrix gives the components and their deviations.

A step for each dimension makes the decomposition whole, equal eigenvalues included: where the recurrence
ends early it goes on from a fresh direction. So `width` passes are made over the fit list; what the driver
and the tasks hold is a few matrices of width x width.

Integers keep the centring exact: a row is (n x - S) / n with S the sum of the n rows.

Defined results: rows whose vector is null, or holds a null, a non-finite entry or one beyond 2^20 in
magnitude, are left out, as are rows of another length than most have (the longer of equally frequent
lengths) and empty vectors. Equal vectors count once in the fit and each gets its rows in the result.
Components without variance (below 1e-12 of the first) are not returned, so a table of one distinct vector,
and an empty one, give no rows. A null id is kept. `deviation` is null where it does not fit 64 bits.
Columns other than id and vector are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import store
from pulsegate.llm.vectors import LARGEST, column_sums, doubles, few_rows, in_blocks, matrix, narrow, sound, usual_width, wide

SCALE = 256
COMPONENTS = 4
# Against the largest number seen: below it a direction of the recurrence is rounding error.
BREAKDOWN = 1e-13
# Of the first eigenvalue: below it a component has no variance.
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: n rows with per-dimension sums, unit components by falling eigenvalue."""

    n: int
    sums: np.ndarray
    components: np.ndarray  # width x components
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def integer_rows(embeddings: DataFrame, vector: str = "embedding", id: str = "vec_id") -> tuple[DataFrame, int]:
    """id and x, the vector in integers, of the sound rows, and their width (0 without rows)."""
    rows = embeddings.select(F.col(id).cast("long").alias("id"), doubles(F.col(vector)).alias("v")).filter(sound(F.col("v"), LARGEST))
    width = usual_width(rows, "v") or 0
    rows = rows.filter((F.size("v") == width) & (F.size("v") > 0))
    return rows.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x")), width


def fit_blocks(rows: DataFrame, width: int) -> DataFrame:
    """kind, x: the distinct vectors in blocks; n and sums of each block."""

    def pack(batches):
        for _, x in in_blocks(batches, width):
            small = narrow(x)
            yield pa.RecordBatch.from_pydict({
                "n": [len(x)], "sums": pa.array([x.sum(0)], pa.list_(pa.int64())), "kind": [small.dtype.str], "x": pa.array([small.tobytes()], pa.binary()),
            })

    return store(rows.select("x").distinct().mapInArrow(pack, "n long, sums array<long>, kind string, x binary"), "whitening-fit")


def over_blocks(blocks: DataFrame, width: int, task, size: int) -> np.ndarray:
    """The sum over all blocks of task(matrix), an array of `size` numbers."""

    def partial(batches):
        total = np.zeros(size)
        for batch in batches:
            for kind, raw in zip(batch["kind"].to_pylist(), batch["x"]):
                total += task(wide(raw.as_buffer(), kind, width))
        yield pa.RecordBatch.from_pydict({"part": pa.array([total], pa.list_(pa.float64()))})

    with few_rows(blocks.sparkSession):
        found = column_sums(blocks.select("kind", "x").mapInArrow(partial, "part array<double>"), "part")
    return np.array([found.get(i, 0.0) for i in range(size)])


def bidiagonalise(product, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (as columns) and singular values of X, falling.

    product(q, left): for coefficients q and the coefficients of the left vectors so far (as columns) gives
    X^T X q, the products of X q with the left vectors, and the square of its length.
    """
    rng = np.random.default_rng(20)
    right, left, back = np.empty((width, 0)), np.empty((width, 0)), np.empty((width, 0))
    alphas, betas = [], []

    def fresh() -> np.ndarray:
        v = rng.standard_normal(width)
        for _ in range(3):
            v -= right @ (right.T @ v)
            v /= np.linalg.norm(v)
        return v

    v, beta, last = fresh(), 0.0, np.zeros(width)
    for step in range(width):
        right = np.column_stack([right, v])
        # X v less its share of the left vector before, as coefficients; then less all left vectors.
        q = v - beta * last
        returned, overlap, square = product(q, left)
        q, returned = q - left @ overlap, returned - back @ overlap
        alpha = float(np.sqrt(max(square - overlap @ overlap, 0.0)))
        largest = max([alpha, *alphas, *betas])
        if alpha <= BREAKDOWN * largest:
            alpha, a, b = 0.0, np.zeros(width), np.zeros(width)
        else:
            a, b = q / alpha, returned / alpha
        left, back = np.column_stack([left, a]), np.column_stack([back, b])
        alphas.append(alpha)
        if step + 1 == width:
            break
        z = b - alpha * v
        for _ in range(2):
            z -= right @ (right.T @ z)
        beta = float(np.linalg.norm(z))
        if beta <= BREAKDOWN * largest:
            beta, v = 0.0, fresh()
        else:
            v = z / beta
        betas.append(beta)
        last = a
    _, deviations, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
    found = right @ turned.T
    return found / np.linalg.norm(found, axis=0), deviations


def fit_whitening(rows: DataFrame, width: int, components: int = COMPONENTS) -> tuple[Whitening | None, float]:
    """The whitening of the distinct vectors `x` of `rows`, and the identity error; None if nothing varies."""
    if not width:
        return None, 0.0
    blocks = fit_blocks(rows, width)
    n = blocks.agg(F.sum("n")).head()[0] or 0
    totals = column_sums(blocks, "sums")
    if n < 2:
        return None, 0.0
    sums = np.array([totals[i] for i in range(width)], np.int64)
    centred = Whitening(n, sums, np.empty((width, 0)), np.empty(0), 1.0).centred
    trace = over_blocks(blocks, width, lambda x: np.array([(centred(x) ** 2).sum()]), 1)[0] / n

    def product(q, left):
        def task(x):
            rows = centred(x)
            w = rows @ q
            return np.concatenate([rows.T @ w, (rows @ left).T @ w, [w @ w]])

        found = over_blocks(blocks, width, task, width + left.shape[1] + 1)
        return found[:width], found[width:-1], found[-1]

    vectors, deviations = bidiagonalise(product, width)
    eigenvalues = deviations**2 / n
    kept = np.flatnonzero(eigenvalues > LEAST_SHARE * eigenvalues[0])[:components]
    model = Whitening(n, sums, vectors[:, kept], eigenvalues[kept], trace)
    k = len(kept)

    def moments(x):
        w = model.project(x)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    found = over_blocks(blocks, width, moments, k + k * k)
    mean = found[:k] / n
    error = float(np.abs(found[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return model, error


def deviations_of(x: np.ndarray, model: Whitening) -> list[int | None]:
    """The exact sum of (n x - S)^2 of each row; None beyond 64 bits."""
    reach = model.n * int(np.abs(x).max(initial=0)) + int(np.abs(model.sums).max(initial=0))
    if reach * reach * x.shape[1] < 1 << 63:
        return ((model.n * x - model.sums) ** 2).sum(1).tolist()
    exact = [sum((model.n * a - s) ** 2 for a, s in zip(row, model.sums.tolist())) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(rows: DataFrame, width: int, model: Whitening) -> DataFrame:
    """id, deviation and the whitened vector of each row of `rows` (id, x)."""

    def apply(batches):
        for batch in batches:
            x = matrix(batch["x"], width)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(deviations_of(x, model), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(model.project(x).ravel()), len(model.eigenvalues)).cast(pa.list_(pa.float64()))],
                names=["id", "deviation", "whitened"],
            )

    return rows.mapInArrow(apply, "id long, deviation long, whitened array<double>")


def whitening_digest(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each sound row and component."""
    rows, width = integer_rows(embeddings)
    model, error = fit_whitening(rows, width, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*(F.lit(float(e)) for e in model.explained))
    each = whiten(rows, width, model).select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
