"""Distributed second moments: the only pass over the data a linear fit needs.

Each task adds up X'WX blocks of its Arrow batches in numpy and hands on one small matrix per group. Spark sums
the matrices; the driver receives groups x (p+2)^2 numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Rows are weighted by 1, by y^2, or by max(|y|^power, floor).
ONE = ("one", 0.0, 0.0)
Y_SQUARED = ("y_squared", 0.0, 0.0)


def abs_power(power: float, floor: float) -> tuple[str, float, float]:
    return ("abs_power", float(power), float(floor))


def weights(kind: tuple[str, float, float], y: np.ndarray) -> np.ndarray:
    name, power, floor = kind
    if name == "one":
        return np.ones_like(y)
    if name == "y_squared":
        return y * y
    return np.maximum(np.abs(y) ** power, floor)


@dataclass
class Moments:
    """Sums of w * d d' with d = (1, x - shift, y), and of w, for one set of rows."""

    matrix: np.ndarray
    shift: np.ndarray
    n: float

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.matrix - other.matrix, self.shift, self.n - other.n)

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.matrix + other.matrix, self.shift, self.n + other.n)

    @property
    def weight(self) -> float:
        return float(self.matrix[0, 0])

    def select(self, columns: Sequence[int]) -> "Moments":
        keep = [0, *[c + 1 for c in columns], self.matrix.shape[0] - 1]
        return Moments(self.matrix[np.ix_(keep, keep)], self.shift[list(columns)], self.n)


def feature_array(columns: Sequence[str]) -> Column:
    """The columns as one array<double>: wide designs stay one column for Spark and one block for numpy."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).cast("array<double>")


def block(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """An array column of one Arrow batch as a matrix, without copying row by row."""
    rows = batch.column(column)
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def sum_vectors(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of array column `v` per key. Every task adds what it receives; a key's rows number the map tasks."""
    names = list(keys)
    schema = ", ".join(f"{n} int" for n in names) + ", v array<double>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            values = block(batch, "v")
            for row, key in enumerate(zip(*(batch.column(n).to_pylist() for n in names))):
                sums[key] = sums[key] + values[row] if key in sums else values[row].copy()
        if sums:
            columns = {n: pa.array([k[i] for k in sums], pa.int32()) for i, n in enumerate(names)}
            columns["v"] = pa.array(list(sums.values()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(columns)

    return parts.repartition(*names).mapInArrow(add, schema)


def provisional_shift(x: DataFrame) -> np.ndarray:
    """Column means of the array column `x`, subtracted before squares are added.

    Raw second moments of far-from-zero columns cancel badly; a shift near the data cures that.
    """

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                part = block(batch).sum(axis=0)
                total, n = part if total is None else total + part, n + batch.num_rows
        if n:
            line = pa.array([np.append(total, n)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), line], ["one", "v"])

    rows = sum_vectors(x.select("x").mapInArrow(totals, "one int, v array<double>"), ["one"]).collect()
    return np.array(rows[0]["v"][:-1]) / rows[0]["v"][-1] if rows else np.zeros(0)


def collect_moments(
    df: DataFrame,
    features: Sequence[str] | None,
    target: str,
    groups: Sequence[str],
    kinds: Sequence[tuple[str, float, float]] = (ONE,),
    shift: np.ndarray | None = None,
) -> dict[tuple[int, int, int], Moments]:
    """{(kind number, group column number, group value): Moments} in one pass over the table.

    `features` None means the table already has the array column `x`.
    """
    groups, kinds = list(groups), list(kinds)
    x = F.col("x") if features is None else feature_array(features).alias("x")
    rows = df.select(x, F.col(target).cast("double").alias("__y"), *[F.col(g).cast("int").alias(g) for g in groups])
    shift = provisional_shift(rows) if shift is None else shift
    width = len(shift) + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        counts: dict[tuple[int, int, int], float] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y = numbers(batch, "__y")
            d = np.column_stack([np.ones(len(y)), block(batch).reshape(len(y), -1) - shift, y])
            for k, kind in enumerate(kinds):
                weighted = d * weights(kind, y)[:, None]
                for g, column in enumerate(groups):
                    cell = numbers(batch, column)
                    for value in np.unique(cell):
                        rows = cell == value
                        key = (k, g, int(value))
                        part = d[rows].T @ weighted[rows]
                        sums[key] = sums[key] + part if key in sums else part
                        counts[key] = counts.get(key, 0.0) + float(rows.sum())
        for (k, g, value), part in sums.items():
            # The row count rides along as one more entry of each matrix row.
            lines = np.column_stack([part, np.full(width, counts[(k, g, value)])])
            fixed = {n: pa.array(np.full(width, v), pa.int32()) for n, v in (("kind", k), ("grp", g), ("cell", value))}
            fixed["i"] = pa.array(np.arange(width), pa.int32())
            fixed["v"] = pa.array(list(lines), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(fixed)

    parts = rows.mapInArrow(partial, "kind int, grp int, cell int, i int, v array<double>")
    out: dict[tuple[int, int, int], Moments] = {}
    for row in sum_vectors(parts, ["kind", "grp", "cell", "i"]).toArrow().to_pylist():
        key = (row["kind"], row["grp"], row["cell"])
        if key not in out:
            out[key] = Moments(np.zeros((width, width)), shift, row["v"][-1])
        out[key].matrix[row["i"]] = row["v"][:-1]
    return out
