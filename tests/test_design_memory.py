"""Memory and results of the products of sparse columns inside a task."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tickloom.plans import design
from tickloom.plans.design import Batch, FoldPlan, Sums, add_pairs, dense_products, stretches


def _raw(rng, n, dense, columns, entries):
    ks = [np.sort(rng.choice(columns, entries, replace=False)) for _ in range(n)]
    lists = lambda values, kind: pa.array([list(v) for v in values], pa.list_(kind))
    return pa.RecordBatch.from_pydict(
        {
            "session": pa.array(range(n), pa.int64()),
            "target_return": pa.array(rng.normal(size=n)),
            "x": lists(rng.normal(size=(n, dense)), pa.float64()),
            "fold_0": pa.array(rng.integers(0, 5, n), pa.int32()),
            "cells": lists([[0] * entries] * n, pa.int32()),
            "ks": lists(ks, pa.int32()),
            "vs": lists(rng.normal(size=(n, entries)), pa.float64()),
        }
    )


def _matrix(batch, columns):
    out = np.zeros((len(batch.y), columns))
    np.add.at(out, (batch.row, batch.k), batch.v)
    return out


def test_products_by_blocks_and_by_pairs(monkeypatch):
    """Every cut of the blocks, and pair by pair, gives the products of the whole matrices; what is not finite stays in its row."""
    raw = _raw(np.random.default_rng(1), 40, 3, 12, 5)
    batch = Batch(raw, FoldPlan())
    every, w = np.arange(len(batch.k)), np.linspace(0.5, 2.0, 40)
    s = _matrix(batch, 12)
    expected, d = s.T @ (s * w[:, None]), batch.x
    for values, most in ((2_000_000, 1024), (30, 1024), (30, 2)):
        monkeypatch.setattr(design, "BLOCK_VALUES", values)
        monkeypatch.setattr(design, "BLOCK_COLUMNS", most)
        for half in (True, False):
            sums = Sums()
            add_pairs(sums, batch, every, every, w, 12, half)
            keys, got = sums.done()
            found = np.zeros((12, 12))
            found[keys // 12, keys % 12] = got[:, 0]
            np.testing.assert_allclose(found, np.triu(expected) if half else expected, atol=1e-12)
        columns, lines = dense_products(batch, every, d, w)
        np.testing.assert_allclose(lines, (s.T @ (d * w[:, None]))[columns], atol=1e-12)
        parts = [Batch(part, FoldPlan()) for part in stretches(iter([raw]))]
        np.testing.assert_array_equal(np.vstack([_matrix(p, 12) for p in parts]), s)
    batch.v = batch.v.copy()
    batch.v[0] = np.inf
    sums = Sums()
    add_pairs(sums, batch, every, every, w, 12, True)
    keys, got = sums.done()
    held = set(batch.k[batch.row == 0].tolist())
    assert {int(c) for key, v in zip(keys, got[:, 0]) if not np.isfinite(v) for c in (key // 12, key % 12)} <= held


def test_memory_does_not_follow_the_batch():
    """A batch of 4,000 rows with 100 entries and 100 dense columns once took 320 MB a copy: every entry met all dense columns at once."""
    raw = _raw(np.random.default_rng(2), 4000, 100, 400, 100)
    tracemalloc.start()
    for part in stretches(iter([raw])):
        batch = Batch(part, FoldPlan())
        every, w = np.arange(len(batch.k)), np.ones(len(batch.y))
        dense_products(batch, every, batch.x, w)
        add_pairs(Sums(), batch, every, every, w, 400, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000
