"""Regression forest grown level by level from histograms, with draws that any engine can repeat.

Every feature is cut into equal bins between its smallest and largest value. A row counts in a tree as often as a Poisson draw from the md5 of seed,
tree and session says. Each level is one pass: tasks walk their rows down the splits found so far and add up weight, target and squared
target by (tree, node, feature, bin); Spark sums these and picks the best split of each node. Only splits reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.plans.moments import block, feature_array, numbers
from tickloom.session import materialize

BINS = 32
#: P(draw <= k) of a Poisson variable with mean 1, for k = 0, 1, ...
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
LEAST_GAIN = 1e-12
SAME_GAIN = 1e-9  # gains closer than this share of the best are equal: sums come in any order


def draws(seed: int, trees: int):
    """An array with how often the session counts in each tree."""

    def one(tree):
        text = F.concat_ws(":", F.lit(str(seed)), tree.cast("string"), F.col("session").cast("string"))
        u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("double") / float(1 << 28)
        return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), one)


@dataclass
class Forest:
    """Node 1 is a tree's root; node k has the children 2k (bin at most the split's) and 2k + 1."""

    columns: list[str]
    low: np.ndarray
    width: np.ndarray
    trees: int
    splits: list[tuple[int, int, int, int, float, float]]  # tree, node, feature, bin, gain, weight
    leaves: dict[tuple[int, int], float]  # mean target of every node that was reached

    def bins(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            cut = np.floor(np.where(self.width > 0, (x - self.low) / self.width, 0.0))
        return np.clip(np.nan_to_num(cut), 0, BINS - 1).astype(np.int64)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The deepest node of every row in every tree."""
        at = np.ones((len(bins), self.trees), np.int64)
        for tree, node, feature, cut, _, _ in sorted(self.splits, key=lambda s: s[1]):
            here = at[:, tree] == node
            at[here, tree] = 2 * node + (bins[here, feature] > cut)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean over the trees that drew any row; 0 if none did."""
        at = self.nodes(self.bins(x))
        total = np.zeros(len(x))
        grown = [tree for tree in range(self.trees) if (tree, 1) in self.leaves]
        for tree in grown:
            names, place = np.unique(at[:, tree], return_inverse=True)
            total += np.array([self.leaves[(tree, int(n))] for n in names])[place]
        return total / max(1, len(grown))

    def importances(self) -> list[tuple[str, float]]:
        """Each feature's share of the gain, averaged over the trees that split at all."""
        shares = np.zeros((self.trees, len(self.columns)))
        for tree, _, feature, _, gain, _ in self.splits:
            shares[tree, feature] += gain
        sums = shares.sum(axis=1, keepdims=True)
        mean = np.divide(shares, sums, out=np.zeros_like(shares), where=sums > 0).sum(axis=0)
        return list(zip(self.columns, (mean / max(mean.sum(), 1e-300)).tolist()))


def grow(rows: DataFrame, columns: Sequence[str], target: str, trees: int = 100, depth: int = 5, seed: int = 42, least_weight: float = 1.0) -> Forest:
    """A forest over `rows` (session, columns, target), nulls 0.

    A split needs `least_weight` on both sides and a gain in squared error; gains as good as equal go to the first feature, then the lowest bin. The
    driver holds trees x 2^depth splits.
    """
    names = list(columns)
    value = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in names]
    bounds = rows.agg(*[f(v) for v in value for f in (F.min, F.max)]).first()
    low = np.array([0.0 if v is None else v for v in bounds[::2]])
    high = np.array([0.0 if v is None else v for v in bounds[1::2]])
    filled = rows.select("session", F.col(target).cast("double").alias("y"), *[v.alias(c) for v, c in zip(value, names)]).where("y IS NOT NULL")
    design = materialize(filled.select("y", feature_array(names).alias("x"), draws(seed, trees).alias("w")), "forest-rows")
    forest = Forest(names, low, (high - low) / BINS, trees, [], {})
    for level in range(depth + 1):
        found = _level(design, forest, level, last=level == depth, least_weight=least_weight).collect()  # at most trees * 2^level rows
        for r in found:
            forest.leaves[(r["tree"], r["node"])] = r["mean"]
            if r["feature"] is not None:
                forest.splits.append((r["tree"], r["node"], r["feature"], r["bin"], r["gain"], r["weight"]))
        if not any(r["feature"] is not None for r in found):
            break
    return forest


def _level(design: DataFrame, forest: Forest, level: int, last: bool, least_weight: float) -> DataFrame:
    """(tree, node, weight, mean, feature, bin, gain) of every node of a level; no split where none is wanted or helps."""
    p = len(forest.columns)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, nodes = 1 << level, 1 << level
        features = range(1 if last else p)
        sums = np.zeros((3, forest.trees * nodes * len(features) * BINS))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y, w = forest.bins(block(batch)), numbers(batch, "y"), block(batch, "w").astype(float)
            at = forest.nodes(bins)
            row, tree = np.nonzero((at >= first) & (w > 0))
            cell = tree * nodes + at[row, tree] - first
            weight = w[row, tree]
            for f in features:
                key = (cell * len(features) + f) * BINS + bins[row, f]
                for k, v in enumerate((weight, weight * y[row], weight * y[row] ** 2)):
                    sums[k] += np.bincount(key, v, minlength=sums.shape[1])
        used = np.flatnonzero(sums[0])
        tree, node = np.divmod(used // (len(features) * BINS), nodes)
        ints = (tree, node + first, used // BINS % len(features), used % BINS)
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in ints], *[pa.array(s[used]) for s in sums]], ["tree", "node", "feature", "bin", "w", "wy", "wyy"])

    cells = design.mapInArrow(histogram, "tree int, node int, feature int, bin int, w double, wy double, wyy double")
    cells = cells.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("w", "wy", "wyy")])
    if last:
        out = cells.groupBy("tree", "node").agg(F.sum("w").alias("weight"), (F.sum("wy") / F.sum("w")).alias("mean"))
        return out.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("feature", "int"), ("bin", "int"), ("gain", "double"))])
    scope = Window.partitionBy("tree", "node", "feature")  # BINS rows
    upto = scope.orderBy("bin")
    rows = cells.withColumns({"lw": F.sum("w").over(upto), "ly": F.sum("wy").over(upto), "tw": F.sum("w").over(scope), "ty": F.sum("wy").over(scope)})
    rw, ry = F.col("tw") - F.col("lw"), F.col("ty") - F.col("ly")
    good = (F.col("lw") >= least_weight) & (rw >= least_weight)
    gain = F.when(good, F.pow("ly", 2) / F.col("lw") + F.pow(ry, 2) / rw - F.pow("ty", 2) / F.col("tw"))
    rows = rows.withColumn("gain", F.when(gain > LEAST_GAIN, gain))
    rows = rows.withColumn("top", F.max("gain").over(Window.partitionBy("tree", "node")))  # features * BINS rows
    ties = F.when(F.col("gain") >= F.col("top") * (1 - SAME_GAIN), F.struct("feature", "bin", "gain"))
    found = rows.groupBy("tree", "node").agg(F.min(ties).alias("b"), F.max("tw").alias("weight"), F.max(F.col("ty") / F.col("tw")).alias("mean"))
    split = F.col("b.gain").isNotNull()
    return found.select("tree", "node", "weight", "mean", *[F.when(split, F.col(f"b.{c}")).alias(c) for c in ("feature", "bin", "gain")])


def predict(rows: DataFrame, forest: Forest, keep: Sequence[str]) -> DataFrame:
    """`keep` columns of `rows` with the forest's `prediction`."""
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in forest.columns])
    table = rows.select(*keep, x.alias("__x"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                arrays = [batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(forest.predict(block(batch, "__x")))], [*keep, "prediction"])

    return table.mapInArrow(run, f"{schema}, prediction double")
