"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A are too many to factor in one place, but A'A is a small matrix
that partitions sum. A Cholesky factor R1 of A'A, with a small shift on its diagonal,
makes A inv(R1) nearly orthogonal even where A'A alone is too ill-conditioned to
factor; further passes over the rows, each a triangular solve through all factors
so far and another sum, make it orthogonal to double precision. The composed factor
R holds all of A's singular values and right vectors, so its SVD gives the principal
components.

Rows stay on the executors: a pass reads them again, and each task gives the upper
triangle of one matrix, which Spark adds up by place. Only sums and factors of the
size of one vector squared come to the driver. Entries are kept as integers while
they are centred, so that a large common offset costs no digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes at most; three settle any matrix that isn't singular in double precision.
PASSES = 6
#: Directions whose variance is less than this share of the largest count as constant.
FLAT = 1e-13
#: Entries beyond this (2 ** 53) are set to it, with their sign.
BOUND = 1 << 53


def integers(vectors: pa.Array, dims: int, scale: float, offset: int) -> np.ndarray:
    """Rows of ``dims`` entries as floor(scale * entry) + offset."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(scale * flat), -BOUND, BOUND).astype(np.int64).reshape(-1, dims) + offset


class Centre:
    """n vectors of whole numbers with the sums S: takes S/n from rows without loss, n * S/n being whole."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, parts = n, [divmod(s, n) for s in sums]
        self.whole = np.array([q for q, _ in parts], np.int64)
        self.rest = np.array([r for _, r in parts], np.int64)

    def take(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 of each row, exactly; null where it passes 64 bits."""
        d = x - self.whole
        widest = (int(np.abs(d).max()) + 1) * self.n if d.size else 0
        if widest**2 * max(1, x.shape[1]) < 1 << 63:
            return (d * self.n - self.rest).__pow__(2).sum(axis=1).tolist()
        exact = ((d.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def _triangle(read: Callable[[pa.RecordBatch], np.ndarray], k: int) -> Callable:
    """Batches to the upper triangle of the sum of X'X, and the sums of X in row -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, line = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                x = read(batch)
                total += x.T @ x
                line += x.sum(axis=0)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, np.full(k, -1)), pa.int32()), pa.array(np.append(j, np.arange(k)), pa.int32()), pa.array(np.append(total[i, j], line))], ["i", "j", "v"])

    return run


def _gram(rows: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, sums of X) over all rows; k * (k + 3) / 2 numbers come to the driver."""
    out, line = np.zeros((k, k)), np.zeros(k)
    for r in rows.mapInArrow(_triangle(read, k), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r["i"] < 0:
            line[r["j"]] = r["v"]
        else:
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out, line


def _solve(x: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """x inv(R) of each upper factor in turn, by forward substitution over the columns of all rows."""
    for r in factors:
        out = np.empty_like(x)
        for j in range(r.shape[0]):
            out[:, j] = (x[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        x = out
    return x


def shifted_cholesky_qr(rows: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray], n: int, k: int) -> tuple[np.ndarray, int]:
    """``(R, passes)`` with A'A = R'R, where ``read`` gives a batch's rows of A.

    Directions in which A is constant to the last digit keep a Gram value of 0; the
    root of the last Gram matrix, the identity otherwise, puts them into R.
    """
    factors: list[np.ndarray] = []
    unit = np.finfo(float).eps
    for done in range(1, PASSES + 1):
        gram, _ = _gram(rows, lambda batch, f=tuple(factors): _solve(read(batch), list(f)), k)
        values, vectors = np.linalg.eigh(gram)
        if factors and (np.abs(values - 1) < 1e-12).sum() + (values < 1e-12).sum() == k:
            break
        if done == PASSES or not values[-1] > 0:
            break
        # the shift makes up for rounding in the sum; none is needed once the matrix is well-conditioned
        shift = 0.0 if values[0] > 0.01 * values[-1] else 11 * unit * (n * k + k * (k + 1)) / max(n, 1) * values[-1] + unit * np.trace(gram)
        factors.append(np.linalg.cholesky(gram + shift * np.eye(k)).T)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    for f in reversed(factors):
        root = root @ f
    return root, done


def whiten(
    embeddings: DataFrame,
    components: int = 32,
    scale: float = 64.0,
    offset: int = 1_000_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component.

    Vectors that are null, or hold null or non-finite entries, are dropped, as are
    empty ones and those of another length than most vectors have (ties: the
    shortest length). Entries become ``floor(scale * c) + offset``. Components are
    the unit eigenvectors of the covariance (divisor n), numbered from 1 by falling
    eigenvalue e, each with its largest entry positive: ``whitened`` is the centred
    vector projected on it, over sqrt(e); ``explained`` is e over all variance.
    Directions without variance have no whitened values, so fewer components come
    back; none if all vectors are equal. ``deviation`` is the exact sum of
    (n * x - S) ** 2 (null past 64 bits). ``identity_error`` is the largest entry of
    the whitened values' covariance minus the identity, measured over all rows.
    Repeated rows and ids count as often as they stand, null ids are kept, other
    columns are ignored; no vectors, no rows.
    """
    spark = embeddings.sparkSession
    schema = f"vec_id {embeddings.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(F.col(id_col).alias("vec_id"), vector.alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & sound)
    sizes = rows.groupBy(F.size("vector").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    k, n = sizes["k"], sizes["n"]
    rows = rows.where(F.size("vector") == k)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * k
        for batch in batches:
            total = [a + b for a, b in zip(total, integers(batch.column(0), k, scale, 0).astype(object).sum(axis=0) if batch.num_rows else [0] * k)]
        high, low = zip(*(divmod(t, 1 << 40) for t in total))
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["i", "high", "low"])

    sums = [0] * k
    for r in rows.select("vector").mapInArrow(summed, "i int, high long, low long").groupBy("i").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect():
        sums[r["i"]] = (int(r["high"]) << 40) + int(r["low"]) + n * offset
    centre = Centre(n, sums)
    read = lambda batch: centre.take(integers(batch.column(batch.num_columns - 1), k, scale, offset))
    factor, _ = shifted_cholesky_qr(rows.select("vector"), read, n, k)
    _, singular, right = np.linalg.svd(factor)
    right = right * np.sign(right[np.arange(k), np.abs(right).argmax(axis=1)])[:, None]
    variance = singular**2 / n
    kept = min(components, int((variance > FLAT * variance[0]).sum())) if variance[0] > 0 else 0
    if not kept:
        return spark.createDataFrame([], schema)
    project = right[:kept].T * (np.sqrt(n) / singular[:kept])
    explained = variance[:kept] / variance.sum()
    white = lambda batch: read(batch) @ project
    gram, line = _gram(rows.select("vector"), white, kept)
    error = float(np.abs(gram / n - np.outer(line, line) / n / n - np.eye(kept)).max())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = integers(part.column(1), k, scale, offset)
                many = np.repeat(np.arange(len(x)), kept)
                deviation = pa.array(centre.deviation(x), pa.int64()).take(pa.array(many))
                fixed = [pa.array(np.full(len(many), v)) for v in (n, error)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(many)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), fixed[0], deviation, pa.array((centre.take(x) @ project).ravel()), pa.array(np.tile(explained, len(x))), fixed[1]], schema_names)

    schema_names = [f.split()[0] for f in schema.split(", ")]
    return rows.mapInArrow(spread, schema)
