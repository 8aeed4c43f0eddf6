"""Embedding whitening by matrix-free block subspace iteration.

Entries become integers, ``floor(scale * c) + offset``, and the mean and covariance are those of the distinct
integer vectors (the fit list), so copies count once.  The covariance matrix is never formed: a
Spark pass over the centred rows X gives ``X'(XQ)`` for a block Q of directions.  Rayleigh-Ritz within the block gives estimates of
eigenvalues and vectors, whose residuals ``|Vq - eq|`` come from the same pass; QR of the product is the next block.
The iteration ends when the residuals of all k components are below ``tolerance`` times the largest
eigenvalue.  A block that has not got there in ``patience`` passes is doubled; one as wide as the space is exact.

Rows are centred exactly before they are multiplied: ``(n * x - S) / n`` with integers n, x and S.

Scale: one shuffle of the vectors (the distinct ones, combined before it); the fit list is written once and read by
each pass.  A pass sends dimensions x block sums from each task into an aggregate by cell, and the driver holds a
few such blocks whatever the number of rows.

Defined cases: a vector that is null or holds null or non-finite entries is dropped, and one shorter than the longest
counts as holding nulls; a null id is kept; repeated rows are whitened one by one; components without variance
(an eigenvalue below rounding) are left out, so a table of one distinct vector, like an empty table, gives no components;
deviations that do not fit a long are null.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.storage import materialize, spread

#: Entries of a part of a batch.
ENTRIES = 1 << 20


@dataclass(frozen=True)
class Whitening:
    """What :func:`whiten` needs: size and sums of the fit list, unit components as columns, eigenvalues by falling size.

    ``residuals`` are the components' certificates, ``blocks`` the widths of the blocks of all passes.
    """

    scale: int
    offset: int
    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    residuals: np.ndarray
    blocks: list[int]


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int, offset: int) -> DataFrame:
    """vec_id, x: the rows without null or non-finite entries, as integers."""
    sane = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    values: Column = F.col("v").cast("array<double>")
    return (
        vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).filter(F.col("v").isNotNull() & F.forall(values, sane))
        .select("vec_id", F.transform(values, lambda c: F.floor(c * scale) + F.lit(offset).cast("long")).alias("x"))
    )


def _matrices(column: pa.Array, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of the column as matrices, each with the row it begins at."""
    step = max(1, ENTRIES // max(1, d))
    for at in range(0, len(column), step):
        yield at, column.slice(at, step).flatten().to_numpy().reshape(-1, d)


def _offsets(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly; as Python integers where longs could overflow."""
    most = int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max(initial=0))
    return n * (x if most < 1 << 62 else x.astype(object)) - (sums if most < 1 << 62 else sums.astype(object))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_offsets(x, n, sums) / n).astype(np.float64)


def _total(fit: DataFrame, d: int, shape: tuple[int, ...], add: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of ``add`` (a ``shape`` of ``kind``) over all parts of ``fit.x``."""
    cells = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = np.zeros(shape, kind), False
        for batch in batches:
            for _, x in _matrices(batch.column(0), d):
                out, seen = out + add(x), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(out.ravel())], ["cell", "v"])

    got = fit.select("x").mapInArrow(run, f"cell int, v {'long' if kind == 'int64' else 'double'}").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(cells, kind)
    total[got.column("cell").to_numpy()] = got.column("v").to_numpy()
    return total.reshape(shape)


def _ritz(q: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, unit vectors and V times each, of V within the block ``q``; ``product`` is V times q."""
    t = q.T @ product
    e, w = np.linalg.eigh((t + t.T) / 2)
    w = w[:, ::-1]
    return e[::-1], q @ w, product @ w


def _orthonormal(columns: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """A basis of ``columns`` and of random directions up to ``width``; QR twice, so that nearly dependent columns are apart."""
    columns = np.concatenate([columns, rng.standard_normal((len(columns), width - columns.shape[1]))], axis=1)
    return np.linalg.qr(np.linalg.qr(columns)[0])[0]


def fit(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, extra: int = 48, patience: int = 12, tolerance: float = 1e-12,
    scale: int = 64, offset: int = 1_000_000, seed: int = 5,
) -> Whitening:
    """The first ``k`` components of the distinct integer vectors; blocks begin ``k + extra`` wide."""
    rows = integers(vectors, id_col, vec_col, scale, offset)
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return Whitening(scale, offset, 0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, np.zeros(0), [])
    distinct = materialize(spread(rows.filter(F.size("x") == d).select("x")).distinct(), "fit")
    moments = _total(distinct, d, (d + 1,), lambda x: np.append(x.sum(axis=0), len(x)), "int64")
    n, sums = int(moments[-1]), moments[:-1]
    k, rng = min(k, d), np.random.default_rng(seed)
    blocks: list[int] = []
    q = _orthonormal(np.zeros((d, 0)), min(d, k + extra), rng)
    while True:
        blocks.append(q.shape[1])

        def multiply(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            c = _centred(x, n, sums)
            return np.append((c.T @ (c @ q)).ravel(), (c * c).sum())

        found = _total(distinct, d, (q.size + 1,), multiply, "float64") / n
        trace = float(found[-1])
        e, vectors_, products = _ritz(q, found[:-1].reshape(q.shape))
        residuals = np.linalg.norm(products[:, :k] - vectors_[:, :k] * e[:k], axis=0)
        if not trace or q.shape[1] == d or residuals.max() <= tolerance * e[0]:
            break
        stuck = blocks.count(q.shape[1]) >= patience
        q = _orthonormal(products, min(d, 2 * q.shape[1]) if stuck else q.shape[1], rng)
    kept = int((e[:k] > e[0] * d * 8 * np.finfo(float).eps).sum()) if trace else 0
    e, u = e[:kept], vectors_[:, :kept]
    u = u / np.linalg.norm(u, axis=0) * np.where(u[np.abs(u).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0) if kept else u
    model = Whitening(scale, offset, n, sums, u, e, trace, 0.0, residuals[:kept], blocks)

    def second_moments(x: np.ndarray) -> np.ndarray:
        w = _project(x, model)
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    if kept:
        found = _total(distinct, d, (kept * kept + kept,), second_moments, "float64") / n
        mean = found[kept * kept :]
        error = np.abs(found[: kept * kept].reshape(kept, kept) - np.outer(mean, mean) - np.eye(kept)).max()
        model = Whitening(**(model.__dict__ | {"identity_error": float(error)}))
    return model


def _project(x: np.ndarray, m: Whitening) -> np.ndarray:
    return _centred(x, m.n, m.sums) @ m.components / np.sqrt(m.eigenvalues)


def _deviation(x: np.ndarray, m: Whitening) -> pa.Array:
    off = _offsets(x, m.n, m.sums)
    most = max((abs(int(v)) for v in (off.min(initial=0), off.max(initial=0))), default=0)
    if most * most * x.shape[1] < 1 << 63:
        return pa.array((off * off).sum(axis=1).astype(np.int64))
    exact = [sum(int(v) ** 2 for v in row) for row in off]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(vectors: DataFrame, model: Whitening, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, deviation, whitened: of each row its squared distance from the mean, times n squared, and its whitened components."""
    shared, d = vectors.sparkSession.sparkContext.broadcast(model.__dict__), len(model.sums)  # plain values: workers need no copy of the package
    rows = integers(vectors, id_col, vec_col, model.scale, model.offset).filter(F.size("x") == (d or -1))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Whitening(**shared.value)
        for batch in batches:
            for at, x in _matrices(batch.column(1), d):
                w = _project(x, m)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), _deviation(x, m), lists], ["vec_id", "deviation", "whitened"])

    return spread(rows).mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def components(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    model = fit(vectors, **options)
    names = {x: options[x] for x in ("id_col", "vec_col") if x in options}
    each = whiten(vectors, model, **names).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)).cast("array<double>")
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
