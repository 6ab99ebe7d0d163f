"""The design of linear fits: dense features as one array, text and category columns as a list of entries.

A row of the design is a session: its dense features once, its fold of every repeat, and its sparse entries (cell, column,
value). Category columns hold in every cell (cell -1). The TF-IDF columns of a fold's train vocabulary hold in its cell alone,
where cell = repeat * folds + fold. No array is as wide as a vocabulary, and nothing is repeated per fold but the entries
that differ by fold.

Moments follow that shape. Whatever holds in every cell is summed per own fold, and train moments are total minus own; what holds in one
cell is summed over its train rows. Sparse columns send only the products that occur.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.operators import tfidf
from tickloom.operators.matrix import align_columns
from tickloom.plans.blocks import FeatureMatrix, TextBlock
from tickloom.plans.moments import Moments, block, feature_array, numbers, provisional_shift, sum_vectors, weights
from tickloom.session import materialize

TARGET = "target_return"
EVERY_CELL = -1
MAX_COLUMNS = 8192  # sparse columns of one fit: the solver works on a square matrix of them
PAIRS_AT_ONCE = 2_000_000
BLOCK_VALUES = 2_000_000  # numbers in one dense block of sparse columns, or of their products with the dense columns
BLOCK_COLUMNS = 1024  # more distinct columns in a block than this are multiplied entry by entry
ENTRIES = "cells array<int>, ks array<int>, vs array<double>"


@dataclass(frozen=True)
class FoldPlan:
    n_folds: int = 5
    n_repeats: int = 1
    seed: int = 42

    @property
    def cells(self) -> list[tuple[int, int]]:
        return [(r, f) for r in range(self.n_repeats) for f in range(self.n_folds)]

    @property
    def fold_columns(self) -> list[str]:
        return [f"fold_{r}" for r in range(self.n_repeats)]


@dataclass
class Categories:
    """Category columns that some fold's train side has, with the cells whose train or valid side lacks them."""

    names: list[str]
    no_train: list[set[int]]
    no_valid: list[set[int]]


@dataclass
class Design:
    """`rows`: session, target, x (dense), entries (cells, ks, vs) of the sparse columns by number, and the folds."""

    rows: DataFrame
    dense: list[str]
    sparse: list[str]
    plan: FoldPlan
    categories: Categories
    category_aliases: list[str]
    vocabularies: dict[str, DataFrame]
    texts: dict[str, TextBlock]
    live: dict[tuple[int, int], set[str]] = field(default_factory=dict)  # text columns with a term, per cell

    @property
    def columns(self) -> list[str]:
        return self.dense + self.sparse

    def block_columns(self, alias: str, fm: FeatureMatrix) -> list[str]:
        own = [f"{alias}__w_{c}" for c in self.categories.names] if alias in self.category_aliases else []
        return fm.columns[alias] + own + (self.texts[alias].columns if alias in self.texts else [])

    def masks(self) -> dict[tuple[int, int], tuple[set[str], set[str]]]:
        """{(repeat, fold): (columns missing in train, columns missing in valid)}; text columns never lack in valid alone."""
        out = {}
        every_text = {c for t in self.texts.values() for c in t.columns}
        for i, cell in enumerate(self.plan.cells):
            lack = [
                {f"{a}__w_{c}" for a in self.category_aliases for c, cells in zip(self.categories.names, sides) if i in cells}
                for sides in (self.categories.no_train, self.categories.no_valid)
            ]
            out[cell] = lack[0] | (every_text - self.live[cell]), lack[1]
        return out


def fold_table(folds: DataFrame, plan: FoldPlan) -> DataFrame:
    """One row per session with its fold of every repeat."""
    picks = [F.max(F.when(F.col("repeat") == r, F.col("fold"))).alias(c) for r, c in enumerate(plan.fold_columns)]
    return folds.groupBy("session").agg(*picks)


def category_columns(counts: DataFrame, folds: DataFrame, plan: FoldPlan) -> Categories:
    """Thresholds of every fold's two sides, resolved by Spark: only columns that a fit will have reach the driver.

    `counts` (session, column, min_total, value); a side has a column where its total reaches the threshold.
    """
    own = counts.join(folds.select("session", "repeat", "fold"), "session")
    own = own.groupBy("column", "repeat", "fold").agg(F.sum("value").alias("n"), F.max(F.greatest("min_total", F.lit(1.0))).alias("least"))
    per_repeat = own.groupBy("column", "repeat").agg(
        F.sum("n").alias("total"), F.max("least").alias("least"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("own")
    )
    here = lambda f: F.coalesce(F.try_element_at("own", f), F.lit(0.0))
    every = F.array(*[F.lit(f) for f in range(plan.n_folds)])
    sides = per_repeat.select(
        "column",
        "repeat",
        F.filter(every, lambda f: F.col("total") - here(f) < F.col("least")).alias("no_train"),
        F.filter(every, lambda f: here(f) < F.col("least")).alias("no_valid"),
    )
    lacks = lambda c: F.flatten(F.collect_list(F.transform(c, lambda f: F.col("repeat") * plan.n_folds + f))).alias(c)
    wide = sides.groupBy("column").agg(lacks("no_train"), lacks("no_valid"), F.count(F.lit(1)).alias("repeats"))
    used = wide.where((F.size("no_train") < plan.n_folds * F.col("repeats")) | (F.col("repeats") < plan.n_repeats))
    rows = used.orderBy("column").limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"More than {MAX_COLUMNS} category columns reach their threshold; raise it or leave the block out.")
    return Categories([r["column"] for r in rows], [set(r["no_train"]) for r in rows], [set(r["no_valid"]) for r in rows])


def fold_vocabulary(text: TextBlock, folds: DataFrame, plan: FoldPlan) -> DataFrame:
    """(cell, slot, term, position, idf): the vocabulary of every cell's train documents.

    One row a term holds its counts in all documents and, as arrays, in each cell's own ones. A term can only be among the best
    of a cell if its count in all documents reaches the last of the best that every cell is sure to have; only such terms meet the cells.
    """
    joined = text.counts.join(fold_table(folds, plan), "session")
    inside = [F.col(f"fold_{r}") == f for r, f in plan.cells]
    own = lambda value, kind: F.array(*[F.sum(F.when(c, value).otherwise(F.lit(0))).cast(kind) for c in inside])
    stats = joined.groupBy("slot", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"), own(F.lit(1), "long").alias("own_df"), own(F.col("n"), "long").alias("own_tf")
    )
    stats = materialize(stats.where(F.col("df") >= text.min_df), "term-stats")
    sure = stats.select("slot", "term", (F.col("df") - F.array_max("own_df")).alias("df"), (F.col("tf") - F.array_max("own_tf")).alias("tf"))
    last = tfidf.cut_vocabulary(sure, ["slot"], text.min_df, text.max_features).where(F.col("position") == text.max_features)
    able = stats.join(F.broadcast(last.select("slot", F.col("tf").alias("least"))), "slot", "left").where("least IS NULL OR tf >= least")
    spread = able.select("slot", "term", "df", "tf", F.posexplode(F.arrays_zip("own_df", "own_tf")).alias("cell", "own"))
    train = spread.select("cell", "slot", "term", (F.col("df") - F.col("own.own_df")).alias("df"), (F.col("tf") - F.col("own.own_tf")).alias("tf"))
    sizes = {(r["repeat"], r["fold"]): r["n"] for r in folds.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = [sum(n for (r, _), n in sizes.items() if r == repeat) for repeat in range(plan.n_repeats)]
    docs = [(i, whole[r] - sizes.get((r, f), 0)) for i, (r, f) in enumerate(plan.cells)]
    n_docs = folds.sparkSession.createDataFrame(docs, "cell int, n_docs long")
    vocab = tfidf.cut_vocabulary(train, ["cell", "slot"], text.min_df, text.max_features).join(F.broadcast(n_docs), "cell")
    return materialize(vocab.withColumn("idf", tfidf.idf(F.col("n_docs"), F.col("df"))).drop("n_docs"), "vocabulary")


def text_entries(text: TextBlock, vocab: DataFrame, cells: int, first: int) -> DataFrame:
    """(session, cell, k, v): TF-IDF weights of every session under each cell's vocabulary; columns from number `first`."""
    bound = cells * text.slots * text.max_features
    found = tfidf.tfidf(text.counts, vocab, ["slot", "session"], ["cell", "slot"], vocab_rows=bound)
    k = F.col("slot") * text.max_features + F.col("position") - 1 + first
    return found.select("session", "cell", k.cast("int").alias("k"), F.col("weight").alias("v"))


def category_entries(sums: DataFrame, categories: Categories, aliases: Sequence[str]) -> DataFrame:
    """(session, cell, k, v) of the weighted category sums (session, column, value), for each block that has them."""
    n = len(categories.names)
    numbered = sums.sparkSession.createDataFrame(list(enumerate(categories.names)), "number int, column string")
    firsts = F.array(*[F.lit(i * n) for i in range(len(aliases))])
    rows = sums.join(F.broadcast(numbered), "column").withColumn("first", F.explode(firsts))
    return rows.select("session", F.lit(EVERY_CELL).alias("cell"), (F.col("first") + F.col("number")).cast("int").alias("k"), F.col("value").alias("v"))


def with_entries(rows: DataFrame, entries: Sequence[DataFrame]) -> DataFrame:
    """`rows` (session, ...) with their entries as three arrays; sessions without any have empty ones."""
    none = [F.array().cast(kind).alias(name) for name, kind in (item.split() for item in ENTRIES.split(", "))]
    if not entries:
        return rows.select("*", *none)
    union = entries[0]
    for more in entries[1:]:
        union = union.unionByName(more)
    lists = union.groupBy("session").agg(F.collect_list(F.struct("cell", "k", "v")).alias("__e"))
    parts = [F.coalesce(F.col(f"__e.{c}"), empty).alias(name) for c, empty, name in zip(("cell", "k", "v"), none, ("cells", "ks", "vs"))]
    return rows.join(lists, "session", "left").select(*rows.columns, *parts)


def build_design(fm: FeatureMatrix, targets: DataFrame, folds: DataFrame, plan: FoldPlan) -> Design:
    """All columns of a feature matrix with everything that depends on the fold. Folds outside 0..n_folds-1 are in every train side."""
    dense = fm.all_columns()
    aliases = fm.category_aliases
    categories, entries, vocabularies = Categories([], [], []), [], {}
    if aliases:
        counts = fm.inputs.news.category_counts.groupBy("session", "column", "min_total").agg(F.sum("value").alias("value"))
        categories = category_columns(counts, folds, plan)
        entries.append(category_entries(fm.inputs.news.category_sums, categories, aliases))
    sparse = [f"{a}__w_{c}" for a in aliases for c in categories.names]
    live: dict[tuple[int, int], set[str]] = {cell: set() for cell in plan.cells}
    for alias, text in fm.texts.items():
        if len(sparse) + len(text.columns) > MAX_COLUMNS:
            raise ValueError(f"More than {MAX_COLUMNS} text and category columns; lower max_features.")
        vocabularies[alias] = vocab = fold_vocabulary(text, folds, plan)
        entries.append(text_entries(text, vocab, len(plan.cells), len(sparse)))
        for r in vocab.groupBy("cell", "slot").agg(F.max("position").alias("n")).collect():
            start = r["slot"] * text.max_features
            live[plan.cells[r["cell"]]].update(text.columns[start : start + r["n"]])
        sparse += text.columns
    rows = targets.select("session", TARGET).join(fm.df, "session", "left").na.fill(0.0, dense)
    rows = rows.select("session", TARGET, feature_array(dense).alias("x")).join(fold_table(folds, plan), "session")
    rows = materialize(with_entries(rows, entries), "design")
    return Design(rows, dense, sparse, plan, categories, aliases, vocabularies, fm.texts, live)


def fitted_rows(df: DataFrame, fm: FeatureMatrix, design: Design) -> DataFrame:
    """Sessions of another set in the shape of a design of one cell: its dense columns (absent ones 0), its categories, its vocabularies."""
    entries, first = [], len(design.category_aliases) * len(design.categories.names)
    if first:
        entries.append(category_entries(fm.inputs.news.category_sums, design.categories, design.category_aliases))
    for alias, vocab in design.vocabularies.items():
        text = replace(design.texts[alias], counts=fm.texts[alias].counts)
        entries.append(text_entries(text, vocab, 1, first))
        first += len(text.columns)
    rows = align_columns(df, design.dense)
    return with_entries(rows.select("session", feature_array(design.dense).alias("x")), entries)


# --- inside tasks ---------------------------------------------------------------------------


@dataclass
class Rows:
    """Some rows of the design under one cell: x @ c works as on a matrix of all columns."""

    x: np.ndarray
    row: np.ndarray
    k: np.ndarray
    v: np.ndarray

    def __len__(self) -> int:
        return len(self.x)

    def __matmul__(self, c: np.ndarray) -> np.ndarray:
        p = self.x.shape[1]
        return self.x @ c[:p] + np.bincount(self.row, self.v * c[p + self.k], minlength=len(self.x))

    def transposed_times(self, t: np.ndarray, shift: np.ndarray, q: int) -> np.ndarray:
        """(X - shift)' t over all columns; sparse columns are not shifted."""
        return np.concatenate([(self.x - shift).T @ t, np.bincount(self.k, self.v * t[self.row], minlength=q)])


class Batch:
    """One Arrow batch of the design."""

    def __init__(self, batch: pa.RecordBatch, plan: FoldPlan):
        self.plan = plan
        self.x, self.y = block(batch).reshape(batch.num_rows, -1), numbers(batch, TARGET) if TARGET in batch.schema.names else None
        self.folds = [numbers(batch, c) for c in plan.fold_columns if c in batch.schema.names]
        lists = batch.column("ks")
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        self.cell, self.k, self.v = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("cells", "ks", "vs"))
        self.of = {int(c): np.flatnonzero(self.cell == c) for c in np.unique(self.cell)}

    def side(self, r: int, f: int, valid: bool) -> np.ndarray:
        inside = self.folds[r] == f
        return inside if valid else ~inside

    def entries(self, cell: int, rows: np.ndarray, every: bool = True) -> np.ndarray:
        """Entries of the marked rows that hold in a cell, by row."""
        parts = [self.of[c] for c in ([EVERY_CELL, cell] if every else [cell]) if c in self.of]
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        at = at[rows[self.row[at]]]
        return at[np.argsort(self.row[at], kind="stable")]

    def rows(self, rows: np.ndarray, cell: int) -> Rows:
        at = self.entries(cell, rows)
        place = np.cumsum(rows) - 1
        return Rows(self.x[rows], place[self.row[at]], self.k[at], self.v[at])


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a design cut into stretches of rows that hold a bounded number of values, however many entries a row has."""
    for raw in batches:
        n = raw.num_rows
        if n:
            held = sum(len(raw.column(c).flatten()) for c in ("x", "ks"))
            step = max(1, BLOCK_VALUES * n // max(1, held))
            for at in range(0, n, step):
                yield raw.slice(at, step)


class Sums:
    """Sums of vectors by an integer key, kept as sorted distinct keys once they are many."""

    def __init__(self, limit: int = 200_000):
        self.keys, self.values, self.size, self.limit = [], [], 0, limit

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if len(keys):
            self.keys.append(keys)
            self.values.append(values)
            self.size += len(keys)
            if self.size > self.limit:
                self.limit = max(self.limit, 2 * len(self.done()[0]))

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        keys, values = np.concatenate(self.keys), np.concatenate(self.values)
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.diff(keys[order], prepend=-1))
        self.keys, self.values = [keys[order][heads]], [np.add.reduceat(values[order], heads, axis=0)]
        self.size = len(heads)
        return self.keys[0], self.values[0]


def dense_products(batch: Batch, a: np.ndarray, d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sparse columns of the entries `a`, and the weighted sum of the dense rows `d` that each one meets.

    Every entry meets all dense columns, so the entries go in stretches of a bounded number of values: as a product of two dense blocks
    for few distinct columns, which costs as much for any number of entries, and else one by one.
    """
    columns, place = np.unique(batch.k[a], return_inverse=True)
    lines = np.zeros((len(columns), d.shape[1]))
    v = batch.v[a] * w[batch.row[a]]
    # What is not finite must meet its own row only.
    if 0 < len(columns) <= BLOCK_COLUMNS and np.isfinite(v).all() and np.isfinite(d).all():
        rows, line = np.unique(batch.row[a], return_inverse=True)  # entries come by row
        step = max(1, BLOCK_VALUES // len(columns))
        for low in range(0, len(rows), step):
            some = slice(*np.searchsorted(line, (low, low + step)))
            x = np.zeros((min(step, len(rows) - low), len(columns)))
            np.add.at(x, (line[some] - low, place[some]), v[some])
            lines += x.T @ d[rows[low : low + step]]
        return columns.astype(np.int64), lines
    order = a[np.argsort(batch.k[a], kind="stable")]
    place = np.searchsorted(columns, batch.k[order])
    step = max(1, BLOCK_VALUES // d.shape[1])
    for low in range(0, len(order), step):
        some, to = order[low : low + step], place[low : low + step]
        starts = np.flatnonzero(np.diff(to, prepend=-1))
        lines[to[starts]] += np.add.reduceat(d[batch.row[some]] * (batch.v[some] * w[batch.row[some]])[:, None], starts, axis=0)
    return columns.astype(np.int64), lines


def add_pairs(sums: Sums, batch: Batch, a: np.ndarray, b: np.ndarray, w: np.ndarray, q: int, half: bool) -> None:
    """Weighted products of every entry of `a` with those of `b` in the same row, under key ka * q + kb (both sorted by row).

    Entries go in stretches of whole rows. A stretch of few distinct columns is one product of two dense blocks, which costs as much for
    any number of entries; others send their pairs. Either way a stretch holds a bounded number of values, whatever the batch.
    """
    if not len(a) or not len(b):
        return
    rows = np.union1d(batch.row[a], batch.row[b])
    ca, cb = np.unique(batch.k[a]), np.unique(batch.k[b])
    step = max(1, BLOCK_VALUES // (len(ca) + len(cb)))
    for low in range(0, len(rows), step):
        ends = rows[low], rows[min(low + step, len(rows)) - 1]
        left, right = (x[np.searchsorted(batch.row[x], ends[0]) : np.searchsorted(batch.row[x], ends[1], side="right")] for x in (a, b))
        if not len(left) or not len(right):
            continue
        v, u = batch.v[left] * w[batch.row[left]], batch.v[right]
        # What is not finite must meet the entries of its own row only.
        if max(len(ca), len(cb)) <= BLOCK_COLUMNS and np.isfinite(v).all() and np.isfinite(u).all():
            n = min(step, len(rows) - low)
            x, y = np.zeros((n, len(ca))), np.zeros((n, len(cb)))
            np.add.at(x, (np.searchsorted(rows, batch.row[left]) - low, np.searchsorted(ca, batch.k[left])), v)
            np.add.at(y, (np.searchsorted(rows, batch.row[right]) - low, np.searchsorted(cb, batch.k[right])), u)
            product = x.T @ y
            i, j = np.nonzero(np.triu(product) if half else product)
            sums.add(ca[i].astype(np.int64) * q + cb[j], product[i, j][:, None])
        else:
            _add_single_pairs(sums, batch, left, right, w, q, half)


def _add_single_pairs(sums: Sums, batch: Batch, a: np.ndarray, b: np.ndarray, w: np.ndarray, q: int, half: bool) -> None:
    """`add_pairs` of a stretch, one pair at a time."""
    first = np.searchsorted(batch.row[b], batch.row[a])
    many = np.searchsorted(batch.row[b], batch.row[a], side="right") - first
    cuts = np.searchsorted(np.cumsum(many), np.arange(PAIRS_AT_ONCE, many.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE)) + 1
    at = 0
    for cut in np.minimum(cuts, len(a)).tolist():
        n = many[at:cut]
        left = np.repeat(a[at:cut], n)
        right = b[np.repeat(first[at:cut], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        if half:
            upper = batch.k[left] <= batch.k[right]
            left, right = left[upper], right[upper]
        key = batch.k[left].astype(np.int64) * q + batch.k[right]
        distinct, place = np.unique(key, return_inverse=True)
        sums.add(distinct, np.bincount(place, batch.v[left] * batch.v[right] * w[batch.row[left]])[:, None] if len(key) else np.zeros((0, 1)))
        at = cut


def design_moments(design: Design, kinds: Sequence[tuple[str, float, float]], shift: np.ndarray) -> dict[tuple[int, int, int], Moments]:
    """{(kind, repeat, fold): train moments over all columns of the design}, in one pass over its rows.

    Vectors have one entry for each of (1, dense columns, y). A dense column's row of the moments is such a vector, and so is that of a sparse
    column against the dense ones; products of two sparse columns are single numbers under their pair.
    """
    plan, kinds, p, q = design.plan, list(kinds), len(design.dense), len(design.sparse)
    own_scope, train_scope = 0, 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: dict[tuple, np.ndarray] = {}
        cross: dict[tuple, Sums] = {}
        pairs: dict[tuple, Sums] = {}

        def sparse(key: tuple, batch: Batch, d: np.ndarray, w: np.ndarray, a: np.ndarray, every: np.ndarray | None) -> None:
            if not len(a):
                return
            cross.setdefault(key, Sums()).add(*dense_products(batch, a, d, w))
            sums = pairs.setdefault(key, Sums())
            add_pairs(sums, batch, a, a, w, q, True)
            if every is not None and len(every):
                add_pairs(sums, batch, a, every, w, q, False)

        for raw in stretches(batches):
            batch = Batch(raw, plan)
            d = np.column_stack([np.ones(len(batch.y)), batch.x - shift, batch.y])
            for n, kind in enumerate(kinds):
                w = weights(kind, batch.y)
                weighted = d * w[:, None]
                for r, column in enumerate(batch.folds):
                    for f in np.unique(column).tolist():
                        rows = column == f
                        key = (n, r, f, own_scope)
                        part = np.column_stack([d[rows].T @ weighted[rows], np.full(p + 2, float(rows.sum()))])
                        dense[key] = dense[key] + part if key in dense else part
                        sparse(key, batch, d, w, batch.entries(EVERY_CELL, rows, every=False), None)
                for cell in (c for c in batch.of if c >= 0):
                    r, f = plan.cells[cell]
                    rows = batch.side(r, f, valid=False)
                    sparse((n, r, f, train_scope), batch, d, w, batch.entries(cell, rows, every=False), batch.entries(EVERY_CELL, rows, every=False))

        def lines(key: tuple, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            named = {c: pa.array(np.full(len(i), x), pa.int32()) for c, x in zip(("kind", "grp", "cell", "scope"), key)}
            lists = pa.ListArray.from_arrays(np.arange(len(i) + 1, dtype=np.int32) * v.shape[1], pa.array(np.ascontiguousarray(v).reshape(-1)))
            return pa.RecordBatch.from_pydict({**named, "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": lists})

        for key, part in dense.items():
            yield lines(key, np.arange(p + 2), np.full(p + 2, -1), part)
        for key, sums in cross.items():
            k, v = sums.done()
            yield lines(key, p + 2 + k, np.full(len(k), -1), np.column_stack([v, np.zeros(len(k))]))
        for key, sums in pairs.items():
            if sums.size:
                k, v = sums.done()
                yield lines(key, k // q, k % q, v)

    parts = design.rows.mapInArrow(partial, "kind int, grp int, cell int, scope int, i int, j int, v array<double>")
    if q:
        parts = materialize(parts, "moments")  # read twice: as vectors, and as single numbers
    width = p + q + 2
    place = np.concatenate([[0], np.arange(1, p + 1), [width - 1], np.arange(p + 1, width - 1)])  # where line i of the parts goes
    found: dict[tuple, Moments] = {}

    def moments(key: tuple) -> Moments:
        if key not in found:
            found[key] = Moments(np.zeros((width, width)), np.concatenate([shift, np.zeros(q)]), 0.0)
        return found[key]

    keys = ["kind", "grp", "cell", "scope", "i"]
    for r in sum_vectors(parts.where("j < 0").select(*keys, "v"), keys).toLocalIterator():
        m, v, i = moments((r["kind"], r["grp"], r["cell"], r["scope"])), np.array(r["v"]), place[r["i"]]
        m.matrix[i, place[: p + 2]] = v[:-1]
        if r["i"] >= p + 2:
            m.matrix[place[: p + 2], i] = v[:-1]
        elif r["i"] == 0:
            m.n = v[-1]
    if q:
        t = parts.where("j >= 0").groupBy("kind", "grp", "cell", "scope", "i", "j").agg(F.sum(F.col("v")[0]).alias("v")).toArrow()
        ids = [t[c].to_numpy() for c in ("kind", "grp", "cell", "scope")]
        i, j, v = (t[c].to_numpy() for c in ("i", "j", "v"))
        for key in set(zip(*(x.tolist() for x in ids))):
            here = np.logical_and.reduce([x == y for x, y in zip(ids, key)])
            m = moments(key).matrix
            m[1 + p + i[here], 1 + p + j[here]] = v[here]
            m[1 + p + j[here], 1 + p + i[here]] = v[here]
    out = {}
    for n in range(len(kinds)):
        for r, f in plan.cells:
            parts_ = [m for (k, g, _, s), m in found.items() if (k, g, s) == (n, r, own_scope)]
            total = parts_[0]
            for part in parts_[1:]:
                total = total + part
            own = found.get((n, r, f, own_scope))
            train = total - own if own else total
            text = found.get((n, r, f, train_scope))
            out[(n, r, f)] = Moments(train.matrix + text.matrix, train.shift, train.n) if text else train
    return out


def dense_shift(design: Design) -> np.ndarray:
    return provisional_shift(design.rows) if design.dense else np.zeros(0)
