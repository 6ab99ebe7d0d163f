"""Dataset profile, target distribution and feature correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.numeric import ratio
from tickloom.functions.ranking import ranked
from tickloom.plans.moments import block, feature_array, sum_vectors


def profile(df: DataFrame, session: str = "session") -> DataFrame:
    """One row per column: null fraction, with the table's shape and distinct session count. One pass."""
    names = df.columns
    fractions = [F.avg(F.col(f"`{n}`").isNull().cast("double")).alias(f"__{i}") for i, n in enumerate(names)]
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(F.col(f"`{session}`")).alias("n_sessions"),
        *fractions,
    )
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("column_name"), F.col(f"__{i}").alias("null_fraction"))
            for i, n in enumerate(names)
        ]
    )
    return row.select(F.explode(pairs).alias("p"), "n_rows", F.lit(len(names)).alias("n_columns"), "n_sessions").select(
        "p.*", "n_rows", "n_columns", "n_sessions"
    ).orderBy(F.col("null_fraction").desc(), "column_name")


def distribution(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return df.agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.skewness(x).alias("skew"),
        F.kurtosis(x).alias("excess_kurtosis"),
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width density histogram between the column's minimum and maximum; empty bins kept."""
    x = F.col(column)
    values = df.where(x.isNotNull()).select(x.cast("double").alias("x"))
    bounds = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    # One row of bounds, and at most `bins` rows of counts: both broadcasts have a fixed size.
    bin_of = F.least(F.floor(ratio(F.col("x") - F.col("lo"), width)), F.lit(bins - 1))
    counts = (
        values.crossJoin(F.broadcast(bounds))
        .groupBy(F.coalesce(bin_of, F.lit(0)).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    grid = bounds.select("lo", "hi", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = grid.withColumn("bin", F.col("bin").cast("long"))
    rows = F.coalesce(F.col("c"), F.lit(0))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("left_edge"),
        rows.alias("n_rows"),
        ratio(rows.cast("double"), F.col("n") * width).alias("density"),
    )


def qq_positions(df: DataFrame, column: str) -> DataFrame:
    """Ordered values with Filliben plotting positions and their normal quantiles.

    Values are ranked through range partitions, so the table is never sorted in one task.
    """
    x = F.col(column)
    values = df.where(x.isNotNull()).select("session", x.cast("double").alias("ordered_value"))
    order = ranked(values, [], ["ordered_value", "session"], rank="rank_no", size="n")
    n, i = F.col("n"), F.col("rank_no")
    tail = F.pow(F.lit(0.5), F.lit(1.0) / n)
    position = F.when(i == n, tail).when(i == 1, F.lit(1.0) - tail).otherwise((i - 0.3175) / (n + 0.365))
    out = order.select("rank_no", "ordered_value", position.alias("plot_position"))
    return out.withColumn("normal_quantile", normal_quantile(F.col("plot_position")))


# The rational approximations of algorithm AS 241 (Wichura 1988), highest power first.
CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
     5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
MIDDLE = (
    (7.7454501427834140764e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258,
     3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def _fraction(tables: tuple, x: Column) -> Column:
    parts = []
    for table in tables:
        value = F.lit(table[0])
        for coefficient in table[1:]:
            value = value * x + F.lit(coefficient)
        parts.append(value)
    return parts[0] / parts[1]


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution for 0 < p < 1, to about 16 digits, as a plain column."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    far = F.when(r <= 5, _fraction(MIDDLE, r - 1.6)).otherwise(_fraction(TAIL, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _fraction(CENTRE, F.lit(0.180625) - q * q)).otherwise(F.when(q < 0, -far).otherwise(far))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, correlation): Pearson correlation of every pair of columns; null where one does not vary.

    Covariances are over the rows that have both columns, deviations over those that have the one. Tasks add up p x p blocks of their
    batches in numpy, so any number of columns is one array in Spark's plan; the driver gets 3 p x p numbers.
    """
    names, p = list(columns), len(columns)
    means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")) for c in names]).first()
    shift = np.array([0.0 if m is None else m for m in means])
    rows = df.select(feature_array(names).alias("x"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, 3 * p))
        for batch in batches:
            if batch.num_rows:
                x = block(batch)
                there = ~np.isnan(x)
                x, there = np.where(there, x - shift, 0.0), there.astype(float)
                total += np.column_stack([x.T @ x, x.T @ there, there.T @ there])
        lists = pa.array(list(total), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p), pa.int32()), lists], ["i", "v"])

    sums = sum_vectors(rows.mapInArrow(partial, "i int, v array<double>"), ["i"]).toArrow()
    m = np.zeros((p, 3 * p))
    m[sums["i"].to_numpy()] = block(sums.combine_chunks().to_batches()[0], "v")
    product, first, n = m[:, :p], m[:, p : 2 * p], m[:, 2 * p :]
    with np.errstate(divide="ignore", invalid="ignore"):
        covariance = product / n - (first / n) * (first.T / n)
        deviation = np.sqrt(np.maximum(np.diag(covariance), 0.0))
        r = covariance / np.outer(deviation, deviation)
    cells = [(a, b, float(v) if np.isfinite(v) else None) for a, line in zip(names, r) for b, v in zip(names, line)]
    return df.sparkSession.createDataFrame(cells, "feature_a string, feature_b string, correlation double")
