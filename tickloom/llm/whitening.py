"""Whitening of embeddings from exact integer cross-products by bit slices.

Entries are fixed-point integers. A first pass finds each dimension's smallest and largest one; subtracting the smallest leaves few bits. Tasks pack each bit
of a dimension across their rows into 64-bit words. The cross-product of two dimensions is the sum, over pairs of bit
planes, of 2^(b + c) times the number of rows that have both bits: an AND and a count of ones a word. Spark sums the counts; the driver
centres the cross-products as integers, and only then divides and takes eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import query, table
from tickloom.session import materialize

SCALE, OFFSET = 1024, 100_000
LARGEST = float(2**53)  # scaled entries beyond are set to it: doubles are no longer apart by one there
LIMB = 40  # cross-products are summed in digits of base 2^40
STATS = "dim int, low long, high long, upper long, lower long"


def fixed_point(column: str = "embedding") -> Column:
    """floor(1024 c) + 100000 for each entry; null for vectors that are null, empty, or hold null or a number that is not finite."""
    v = F.col(column).cast("array<double>")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clipped = lambda c: F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when(v.isNotNull() & ~odd & (F.size(v) > 0), F.transform(v, lambda c: F.floor(clipped(c)) + OFFSET))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return np.asarray(x.flatten()).reshape(len(x), -1)


def bit_planes(u: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit b of dimension d over all rows as 64-bit words; planes go by dimension, then by bit."""
    out = np.zeros((int(bits.sum()), -(-len(u) // 64) * 8), np.uint8)
    at = 0
    for d, n in enumerate(bits.tolist()):
        packed = np.packbits(((u[:, d] >> np.arange(n)[:, None]) & 1).astype(np.uint8), axis=1)
        out[at : at + n, : packed.shape[1]] = packed
        at += n
    return out.view(np.uint64)


def add_cross_counts(counts: np.ndarray, planes: np.ndarray, bits: np.ndarray) -> None:
    """Adds to counts[i, j, s], j from i on, how many rows have bit b of dimension i and bit s - b of dimension j."""
    first = np.cumsum(bits) - bits
    dim = np.repeat(np.arange(len(bits)), bits)
    bit = np.arange(len(dim)) - first[dim]
    for i, n in enumerate(bits.tolist()):
        rest = planes[first[i] :]
        for b in range(n):
            both = np.bitwise_count(rest & planes[first[i] + b]).sum(axis=1, dtype=np.int64)
            counts[i, dim[first[i] :], bit[first[i] :] + b] += both


def cross_products(rows: DataFrame, low: np.ndarray, bits: np.ndarray) -> list[list[int]]:
    """Sums over all rows (x) of the products of entries less `low`, for each pair of dimensions, as exact integers."""
    dims, top = len(bits), 2 * int(bits.max(initial=0))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((dims, dims, max(top, 1)), np.int64)
        for batch in batches:
            if batch.num_rows:
                add_cross_counts(counts, bit_planes(_matrix(batch) - low, bits), bits)
        i, j, s = np.nonzero(counts)
        columns = [pa.array(c.astype(np.int32)) for c in (i, j, s)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[i, j, s])], ["i", "j", "s", "n"])

    parts = rows.select("x").mapInArrow(scatter, "i int, j int, s int, n long")
    weight = F.pow(F.lit(2.0), F.col("s") % LIMB).cast("decimal(13,0)")  # a power of two: exact
    sums = parts.groupBy("i", "j", F.floor(F.col("s") / LIMB).alias("limb")).agg(F.sum(F.col("n").cast("decimal(19,0)") * weight).alias("v"))
    out = [[0] * dims for _ in range(dims)]
    for r in sums.collect():  # at most three numbers a pair of dimensions, whatever the rows
        out[r.i][r.j] += int(r.v) << (LIMB * r.limb)
        out[r.j][r.i] = out[r.i][r.j]
    return out


@dataclass(frozen=True)
class Whitening:
    """What was fitted; `basis` holds one unit eigenvector a column, by falling eigenvalue."""

    n: int
    low: np.ndarray
    sums: list[int]  # of the entries less `low`
    reach: int  # the largest |n x - S|
    values: np.ndarray
    basis: np.ndarray
    trace: float

    @property
    def kept(self) -> np.ndarray:
        """Components with a variance; rounding alone makes others differ from 0."""
        return self.values > max(self.trace, 0) * len(self.low) * np.finfo(float).eps

    def project(self, x: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The deviation of each row (null beyond 64 bits), and its whitened components (not a number where there is no variance)."""
        u = x - self.low
        if len(self.low) * self.reach**2 < 2**63:
            away = self.n * u - np.array(self.sums, np.int64)
            deviation = pa.array((away * away).sum(axis=1))
        else:
            away = self.n * u.astype(object) - np.array(self.sums, object)
            exact = (away * away).sum(axis=1)
            deviation = pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())
        root = np.sqrt(np.where(self.kept, self.values, np.nan))
        return deviation, (away / self.n).astype(float) @ self.basis / root


def usable(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the vectors that take part, and their length: the one that most have, the greater of equally frequent ones.

    The integers are written once, in fewer bytes than the vectors, and read by every later pass.
    """
    rows = materialize(vectors.select("vec_id", fixed_point(column).alias("x")).where("x IS NOT NULL"), "fixed-point")
    common = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = common["size"] if common else 0
    return rows.where(F.size("x") == dims), dims


def fit(rows: DataFrame, dims: int, components: int = 8) -> Whitening | None:
    """The whitening of all `rows` (x: `dims` longs); None if there are none.

    Every task sends dims rows, and later dims * dims / 2 rows for each sum of two bit numbers; the driver gets dims * dims / 2 numbers.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                columns = [x.min(axis=0), x.max(axis=0), (x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), *map(pa.array, columns)], ["dim", "low", "high", "upper", "lower"])

    n = rows.count()
    if not n:
        return None
    stats = rows.select("x").mapInArrow(ranges, STATS).groupBy("dim")
    stats = stats.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("upper").alias("upper"), F.sum("lower").alias("lower")).orderBy("dim").collect()
    low = [r.low for r in stats]
    sums = [(r.upper << 26) + r.lower - n * r.low for r in stats]
    bits = np.array([(r.high - r.low).bit_length() for r in stats])
    cross = cross_products(rows, np.array(low, np.int64), bits)
    centred = [[n * c - a * b for c, b in zip(row, sums)] for row, a in zip(cross, sums)]
    covariance = np.array([[c / (n * n) for c in row] for row in centred])
    values, basis = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, basis = values[order], basis[:, order]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(order))])
    reach = max(max(n * (r.high - r.low) - s, s) for r, s in zip(stats, sums))
    return Whitening(n, np.array(low, np.int64), sums, reach, values, basis, float(np.trace(covariance)))


def project(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): one array of components for every row of `rows` (vec_id, x)."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                deviation, white = fitted.project(_matrix(batch))
                missing = np.isnan(white).reshape(-1)
                lists = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], pa.array(white.reshape(-1), mask=missing))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(components, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, fitted: Whitening) -> float | None:
    """The largest entry of |covariance - identity| over all rows of `project`, measured on them; null if no component has a variance."""
    use = np.flatnonzero(fitted.kept)
    k = len(use)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = np.asarray(batch.column("whitened").flatten()).reshape(batch.num_rows, -1)[:, use].astype(float)
                w = np.column_stack([w, np.ones(len(w))])
                at = pa.array(np.arange((k + 1) ** 2), pa.int32())
                yield pa.RecordBatch.from_arrays([at, pa.array((w.T @ w).reshape(-1))], ["cell", "v"])

    sums = np.zeros((k + 1) ** 2)
    for r in whitened.select("whitened").mapInArrow(moments, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        sums[r.cell] = r.v
    m = sums.reshape(k + 1, k + 1) / fitted.n
    return float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max()) if k else None


def whiten(vectors: DataFrame, components: int = 8, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector that takes part and each component from 1.

    Vectors that are null, empty, or hold a null or a number that is not finite take no part, nor do those of another length than most have (of equally
    frequent lengths the greater counts). Entries c become x = floor(1024 c) + 100000, |1024 c| at most 2^53. All rows are fitted on, with
    divisor n; repeated rows count as often as they come, null ids stay, other columns are ignored. deviation is the exact sum of
    (n x - S)^2, null where it does not fit into 64 bits. whitened is the projection of x - S / n over the root of the eigenvalue;
    signs make the largest entry of each eigenvector positive. Components without variance (one vector, equal vectors, more
    components than rows) have null whitened values and stay out of identity_error, which is null if there is no other. There are
    as many components as dimensions if these are fewer. Without vectors there are no rows.
    """
    rows, dims = usable(vectors, column)
    fitted = fit(rows, dims, components)
    if not fitted:
        kinds = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return vectors.select("vec_id", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).where(F.lit(False))
    done = materialize(project(rows, fitted), "whitened")
    error = identity_error(done, fitted)
    share = F.array(*[F.lit(float(max(v, 0.0) / fitted.trace) if fitted.trace > 0 else 0.0) for v in fitted.values])
    out = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, sf_dir):
    """The first eight whitened components of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
