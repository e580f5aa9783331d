"""Whitening of embeddings by LOBPCG over distributed covariance products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import materialize
from tidewater.llm.vectors import finite, list_array, matrix, scaled, usual_length, within

#: Rows of a batch that are multiplied at once.
_ROWS = 8192
#: Scaled entries of this size and over do not take part: they are no exact doubles.
_LARGEST = 2.0**52


@dataclass(frozen=True)
class Components:
    """Eigenpairs of the covariance of the fit list: ``vectors`` has a column for each, by falling ``values``."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    rounds: int


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``vec_id`` and ``x`` (``floor(factor * c) + offset``) of the rows whose vector can be used.

    A null vector, an empty one and one with a null or non-finite entry are left out, as are those with an entry whose scaled
    value is no exact double (2**52 or more) and those of another length than most have.
    """
    good = rows.filter(finite(F.col(vector_col)) & within(F.col(vector_col), factor, _LARGEST))
    found = good.select(F.col(id_col).alias("vec_id"), scaled(F.col(vector_col), factor, offset).alias("x"))
    return found.filter(F.size("x") == usual_length(good, vector_col))


def integer_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            if len(x):
                # High and low halves: the sums of a batch stay within 64 bits whatever the entries.
                high, low = x >> 32, x & 0xFFFFFFFF
                totals = [(int(h) << 32) + int(s) for h, s in zip(high.sum(0), low.sum(0), strict=True)]
                yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, len(totals)), pa.int32()), "s": pa.array([str(t) for t in (len(x), *totals)])})

    parts = fit.select("x").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["i"]: int(r["s"]) for r in parts.collect()}
    return found.get(-1, 0), [found[i] for i in range(len(found) - 1)]


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * x - S``, exact: 64-bit integers where they suffice, else Python's."""
    largest = max(int(np.abs(x).max(initial=0)) * n, *(abs(s) for s in sums), 0)
    if largest < 2**62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


def squared_length(y: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; null where it does not fit 64 bits."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2**63:
        return (y * y).sum(1).tolist()
    exact = (sum(int(v) ** 2 for v in row) for row in y)
    return [v if v < 2**63 else None for v in exact]


def _summed(fit: DataFrame, partial: Callable[[np.ndarray], np.ndarray], n: int, sums: tuple[int, ...], shape: tuple[int, int]) -> np.ndarray:
    """Sum over the centred rows of ``partial``: one matrix for each task, added up by entry in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                total += partial(centred(matrix(batch.column("x").slice(at, _ROWS)), n, sums))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), list_array(total)], ["i", "row"])

    parts = fit.select("x").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros(shape)
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def covariance_product(fit: DataFrame, n: int, sums: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """The covariance times a block of columns, in one pass over the rows; the covariance itself is not formed."""

    def product(block: np.ndarray) -> np.ndarray:
        return _summed(fit, lambda c: c.T @ (c @ block), n, sums, block.shape) / n

    return product


def orthonormal(block: np.ndarray, against: np.ndarray | None = None, least: float = 1e-12) -> np.ndarray:
    """An orthonormal basis of the columns of ``block`` without what ``against`` spans; columns that vanish go."""
    for _ in range(2):
        if against is not None:
            block = block - against @ (against.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > least * s.max(initial=1.0)]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, k: int, guard: int = 8, tolerance: float = 1e-13, max_rounds: int = 200, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The ``k`` largest eigenpairs of a symmetric positive operator: values, vectors, residual norms, rounds.

    Locally optimal block preconditioned conjugate gradients: each round is a Rayleigh-Ritz step on the span of the iterate, its
    residuals and the previous directions, with one product over an orthonormal basis of the three. ``guard`` further columns
    travel along, so that the wanted ones do not wait for their close neighbours. It ends when a fresh product certifies that
    every wanted residual is at most ``tolerance`` times the largest value, which bounds the error of each value; an error is
    raised if that takes over ``max_rounds``.
    """
    m = min(dims, k + guard)
    basis = orthonormal(np.random.default_rng(seed).standard_normal((dims, m)))
    iterate = directions = np.zeros((dims, 0))
    for done in range(1, max_rounds + 1):
        image = product(basis)
        values, mix = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, mix = values[::-1][:m], mix[:, ::-1][:, :m]
        before = iterate.shape[1]
        iterate = basis @ mix
        directions = basis[:, before:] @ mix[before:] if before else directions
        residual = image @ mix - iterate * values
        norms = np.linalg.norm(residual[:, :k], axis=0)
        limit = tolerance * max(values[0], 0.0)
        if (norms <= limit).all():
            iterate = np.linalg.qr(iterate[:, :k])[0]
            image = product(iterate)
            values = np.einsum("ij,ij->j", iterate, image)
            norms = np.linalg.norm(image - iterate * values, axis=0)
            if (norms <= 4 * limit).all():
                order = np.argsort(-values, kind="stable")
                return values[order], iterate[:, order], norms[order], done
            raise ArithmeticError(f"a fresh product gives residuals of {norms.max():.3g}, over {4 * limit:.3g}")
        own = orthonormal(iterate)
        iterate = own if own.shape[1] == m else iterate
        basis = np.hstack([iterate, orthonormal(residual, iterate)])
        if directions.shape[1]:
            basis = np.hstack([basis, orthonormal(directions, basis)])
        basis = basis[:, :dims]
    raise ArithmeticError(f"residuals of {norms.max():.3g} after {max_rounds} rounds, over {limit:.3g}")


def fit_components(fit: DataFrame, k: int = 16, guard: int = 8, tolerance: float = 1e-13, max_rounds: int = 200) -> Components:
    """Components of the fit list ``x`` (each vector once): as many of the first ``k`` as have a positive eigenvalue.

    Every round reads the list anew, so it should be a written table. What reaches the driver has the size of dimensions
    times columns. An empty list, and one of a single vector, have no component.
    """
    n, found = integer_sums(fit)
    sums, dims = tuple(found), len(found)
    trace = float(_summed(fit, lambda c: (c * c).sum(0)[None, :], n, sums, (1, dims)).sum() / n) if n else 0.0
    if trace == 0:
        return Components(n, sums, 0.0, np.zeros(0), np.zeros((dims, 0)), np.zeros(0), 0)
    values, vectors, residuals, rounds = lobpcg(covariance_product(fit, n, sums), dims, min(k, dims), guard, tolerance, max_rounds)
    some = values > 1e-12 * trace
    # Either sign will do: the largest entry of a vector is made positive.
    top = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[top, np.arange(len(top))] < 0, -1.0, 1.0)
    return Components(n, sums, trace, values[some], vectors[:, some], residuals[some], rounds)


def identity_error(fit: DataFrame, model: Components) -> float:
    """Largest entry, in size, of the whitened fit list's covariance minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    onto = model.vectors / np.sqrt(model.values)
    mean = _summed(fit, lambda c: (c @ onto).sum(0)[None, :], model.n, model.sums, (1, k)) / model.n

    def partial(c: np.ndarray) -> np.ndarray:
        w = c @ onto - mean
        return w.T @ w

    return float(np.abs(_summed(fit, partial, model.n, model.sums, (k, k)) / model.n - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, factor: int = 64, offset: int = 1_000_000, guard: int = 8, tolerance: float = 1e-13) -> DataFrame:
    """A row for each row of ``rows`` that can be used and each of its first ``k`` components.

    ``vec_id``, ``component`` (from 1), ``n`` (distinct vectors), ``deviation`` (exact; null if over 64 bits), ``whitened``,
    ``explained``, ``identity_error``. The covariance is that of the distinct integer vectors, so copies weigh once. Rows that
    ``integer_vectors`` leaves out give no row, and neither do components without variance: an empty table or one with
    equal vectors alone gives an empty result. Ids may be null or repeated; equal eigenvalues leave the choice of
    their vectors open. Other columns are not read.
    """
    vectors = materialize(integer_vectors(rows, id_col, vector_col, factor, offset), "whitening-vectors")
    fit = materialize(vectors.select("x").distinct(), "whitening-fit")
    model = fit_components(fit, k, guard, tolerance)
    error, count = identity_error(fit, model), len(model.values)
    n, sums, onto = model.n, model.sums, model.vectors / np.sqrt(model.values) if count else model.vectors
    explained = model.values / model.trace if count else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if count else 0, _ROWS):
                batch = whole.slice(at, _ROWS)
                y = deviations(matrix(batch.column("x")), n, sums)
                rows_ = len(y)
                each = np.repeat(np.arange(rows_), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows_)), pa.array(np.full(len(each), n, dtype=np.int64)),
                        pa.array(squared_length(y), pa.int64()).take(pa.array(each)), pa.array((y.astype(np.float64) / n @ onto).reshape(-1)), pa.array(np.tile(explained, rows_)), pa.array(np.full(len(each), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType), *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    return vectors.mapInArrow(run, kind)
