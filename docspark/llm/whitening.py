"""Embedding whitening: QDWH spectral divide-and-conquer on an exact covariance.

Spark reduces the distinct vectors to integer sums: entries become
x = floor(256 c), vectors are centred on whole numbers before multiplying, and
all partial sums are integers, so the covariance is exact whatever the order
of the partials. What reaches the driver is one number per pair of
dimensions; it grows with the width of the vectors, never with their number.

The spectrum comes from polar decompositions. For a shift s between the least
and the largest eigenvalue of A, the polar factor U of A - s I (by dynamically
weighted Halley steps, each one QR decomposition) gives the spectral projector
(U + I) / 2 on the eigenvalues above s. Its range and the complement are
invariant subspaces; A is compressed to both and split again, the upper part
first, until the wanted components are single vectors.

The whitening matrix is broadcast: width times components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.session import stored

SCALE = 256
#: Relative size below which what couples two parts is rounding.
ROUNDING = 1e-13
#: Eigenvalues below this share of the trace have no usable direction.
NO_VARIANCE = 1e-12
_LIMB = 60
_PARTS = "i int, j int, hi decimal(38,0), lo decimal(38,0)"
_NUMBER = pa.decimal128(38, 0)


# Spectrum ------------------------------------------------------------------

def polar_factor(a: np.ndarray, least: float = 1e-17) -> np.ndarray:
    """The orthogonal factor of symmetric `a`, by QR-based Halley iteration.

    `least` is a lower bound of the scaled singular values; the weights follow
    from it, and six or seven steps reach double precision.
    """
    m = len(a)
    x, bound = a / np.linalg.norm(a), least
    for _ in range(30):
        square = bound * bound
        d = np.cbrt(4 * (1 - square) / (square * square)) if bound < 1 else 0.0
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        basis = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(m)]))[0]
        step = (q / r) * x + (p - q / r) / np.sqrt(r) * (basis[:m] @ basis[m:].T)
        step = (step + step.T) / 2
        change = np.linalg.norm(step - x)
        x, bound = step, min(1.0, bound * (p + q * square) / (1 + r * square))
        if abs(1 - bound) < 1e-15 and change < 1e-10 * np.sqrt(m):
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift.
    None where all eigenvalues are equal up to rounding."""
    m = len(a)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m)) / np.sqrt(m)
    if spread <= ROUNDING * scale:
        return None
    random = np.random.Generator(np.random.PCG64(m))
    best, least = None, np.inf
    # The mean lies strictly inside the spectrum. A shift that hits an
    # eigenvalue gives no projector, so the next one is tried.
    for turn in (0, .037, -.041, .11, -.13, .29, -.31, .53, -.59, .83, -.89):
        shifted = a - (mean + turn * spread) * np.eye(m)
        projector = (polar_factor(shifted) + np.eye(m)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < m:
            continue
        upper = np.linalg.qr(projector @ random.standard_normal((m, rank)))[0]
        whole = np.linalg.qr(projector @ upper, mode="complete")[0]
        upper, lower = whole[:, :rank], whole[:, rank:]
        coupling = np.linalg.norm(lower.T @ a @ upper)
        if coupling < least:
            best, least = (upper, lower), coupling
        if coupling <= ROUNDING * scale:
            break
    return best


def leading_components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of symmetric `a`, falling, and their
    unit eigenvectors as columns."""
    scale = max(np.linalg.norm(a), np.finfo(float).tiny)
    found: list[np.ndarray] = []
    parts = [np.eye(len(a))]
    while parts and len(found) < wanted:
        basis = parts.pop()
        compressed = basis.T @ a @ basis
        halves = _split((compressed + compressed.T) / 2, scale) if basis.shape[1] > 1 else None
        if halves is None:
            found.extend(basis.T)
        else:
            upper, lower = halves
            parts += [basis @ lower, basis @ upper]
    vectors = np.array(found).reshape(-1, len(a)).T
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


# Exact sums ----------------------------------------------------------------

def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64, copy=False)


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def _partials(i: np.ndarray, j: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Integers of any size as two limbs."""
    if sums.dtype == object:
        limbs = [divmod(int(v), 1 << _LIMB) for v in sums]
        hi, lo = (pa.array([Decimal(v) for v in part], _NUMBER) for part in zip(*limbs, strict=True))
    else:
        hi = pa.array(sums >> _LIMB).cast(_NUMBER)
        lo = pa.array(sums & ((1 << _LIMB) - 1)).cast(_NUMBER)
    return pa.RecordBatch.from_arrays(
        [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), hi, lo], names=["i", "j", "hi", "lo"])


def _sums_of_entries(width: int):
    """Rows (i, -1, sum of entry i) per batch group, and (-1, -1, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(width, dtype=object), 0
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            rows += len(x)
            safe = _largest(x) * max(1, len(x)) < 2 ** 62
            total = total + (x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0))
        at = np.arange(-1, width)
        yield _partials(at, np.full(width + 1, -1), np.concatenate([np.array([rows], dtype=object), total]))

    return run


def _sums_of_products(centre: list[int]):
    """Rows (i, j, sum of z_i z_j), i <= j, with z = x - centre."""
    width = len(centre)
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((width, width), dtype=np.int64), 0
        around = np.array(centre, dtype=object)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            reach = _largest(x) + max(map(abs, centre), default=0)
            if reach < 2 ** 62:
                z = x - around.astype(np.int64)
                reach = _largest(z)
            size = len(x) * reach * reach
            if size >= 2 ** 53:
                z = x.astype(object) - around
                yield _partials(i, j, z.T.dot(z)[i, j])
                continue
            if held + size >= 2 ** 62:
                yield _partials(i, j, total[i, j])
                total[:], held = 0, 0
            z = z.astype(np.float64)
            total += (z.T @ z).astype(np.int64)
            held += size
        yield _partials(i, j, total[i, j])

    return run


def _collected(parts: DataFrame) -> dict[tuple[int, int], int]:
    rows = parts.groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()
    return {(r["i"], r["j"]): (int(r["hi"]) << _LIMB) + int(r["lo"]) for r in rows}


# Operator ------------------------------------------------------------------

@dataclass
class Whitening:
    """n distinct vectors with sums S; components as columns, eigenvalues falling."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    fit: DataFrame

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def usable(self) -> np.ndarray:
        return self.values > NO_VARIANCE * self.trace

    @property
    def matrix(self) -> np.ndarray:
        """Columns to project a centred vector on; NaN without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.vectors / np.where(self.usable, np.sqrt(self.values), np.nan)


def whole_numbers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """`embeddings` with x = floor(256 c) of every entry as array<bigint> `_x`,
    without the rows whose vector is null or has null or non-finite entries.
    Numbers beyond a long become the nearest long."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return embeddings.filter(F.col(vector).isNotNull() & finite).withColumn(
        "_x", F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))))


def fit_whitening(
    embeddings: DataFrame, components: int | None = None, vector: str = "embedding",
) -> Whitening | None:
    """Mean and leading components (all, if None) of the distinct vectors.

    The width is that of most distinct vectors, ties the widest; others are
    no points of that space. Without any entry there is nothing to fit: None.
    """
    distinct = stored(whole_numbers(embeddings, vector).select(F.col("_x").alias("x")).distinct(), "vectors")
    widths = distinct.groupBy(F.size("x").alias("w")).count().filter("w > 0")
    top = widths.orderBy(F.desc("count"), F.desc("w")).first()
    if top is None:
        return None
    width = top["w"]
    fit = distinct.filter(F.size("x") == width)
    sums = _collected(fit.mapInArrow(_sums_of_entries(width), _PARTS))
    n, s = sums.pop((-1, -1)), [sums[i, -1] for i in range(width)]
    centre = [(2 * v + n) // (2 * n) for v in s]
    products = _collected(fit.mapInArrow(_sums_of_products(centre), _PARTS))
    rest = [v - n * c for v, c in zip(s, centre, strict=True)]
    covariance = np.zeros((width, width))
    for (i, j), value in products.items():
        covariance[i, j] = covariance[j, i] = (n * value - rest[i] * rest[j]) / (n * n)
    values, vectors = leading_components(covariance, min(components or width, width))
    return Whitening(n, s, values, vectors, float(np.trace(covariance)), fit)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: int64 where that holds it, else Python integers."""
    if n * _largest(x) + max(map(abs, sums)) < 2 ** 63:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _deviation(y: np.ndarray) -> pa.Array:
    """Row sums of squares; null where a long does not hold them."""
    if y.shape[1] * _largest(y) ** 2 < 2 ** 63:
        return pa.array((y * y).sum(axis=1).astype(np.int64))
    exact = [sum(int(v) ** 2 for v in row) for row in y]
    return pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64())


def _project(shared, with_id: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, matrix = shared.value
        for batch in batches:
            y = _centred(_matrix(batch.column("x"), len(sums)), n, sums)
            whitened = pa.array(((y / n).astype(np.float64) @ matrix).ravel(), pa.float64(), from_pandas=True)
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * matrix.shape[1])
            points = pa.ListArray.from_arrays(ends, whitened)
            if with_id:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), _deviation(y), points], names=["vec_id", "deviation", "whitened"])
            else:
                yield pa.RecordBatch.from_arrays([points], names=["whitened"])

    return run


def _shared(model: Whitening, spark):
    return spark.sparkContext.broadcast((model.n, model.sums, model.matrix))


def identity_error(model: Whitening) -> float | None:
    """Largest entry by which the covariance of the whitened fit list differs
    from the identity; None where no component has variance. Measured on the
    whitened vectors themselves, by centred (mergeable) covariances."""
    usable = [int(k) for k in np.flatnonzero(model.usable)]
    if not usable:
        return None
    points = model.fit.mapInArrow(_project(_shared(model, model.fit.sparkSession), False), "whitened array<double>")
    pairs = [(a, b) for a in usable for b in usable if a <= b]
    at = {k: F.get("whitened", F.lit(k)) for k in usable}
    row = points.agg(*[F.covar_pop(at[a], at[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(embeddings: DataFrame, model: Whitening, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, deviation, whitened array<double>) for every row that has a
    vector of the model's width; repeated rows and null ids stay."""
    rows = whole_numbers(embeddings.select(key, vector), vector).filter(F.size("_x") == model.width).select(
        F.col(key).cast("long").alias("vec_id"), F.col("_x").alias("x"))
    return rows.mapInArrow(
        _project(_shared(model, embeddings.sparkSession), True),
        "vec_id long, deviation long, whitened array<double>")


def whitening_report(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """The contract's rows: one per remaining vector and component.

    Repeated vectors count once in the fit and get their rows each. Rows
    whose vector has another width than most distinct vectors are left out,
    as those with missing entries are. A component without variance keeps its
    rows with a null `whitened`; where nothing varies `explained` and
    `identity_error` are null. A `deviation` beyond a long is null. No usable
    vector: no rows. Other columns are not read.
    """
    spark = embeddings.sparkSession
    model = fit_whitening(embeddings, components)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    if model is None:
        return spark.createDataFrame([], schema)
    shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
    explained = F.array(*[F.lit(v).cast("double") for v in shares])
    rows = whiten(embeddings, model)
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"),
        F.lit(identity_error(model)).cast("double").alias("identity_error"))
