"""Exact top-k by inner product with MaxScore, shard by shard.

A shard is a bounded set of rows as an inverted index: for each term the rows that hold it, with the largest and smallest weight as
score bounds. A query adds, for each of its terms, a contribution between two bounds; subtracting the lower one makes all contributions at least
zero. Terms are sorted by the width of their bounds. Those whose widths together stay below the k-th best score so far are
non-essential: no row can reach the top by them alone. The essential postings are traversed for all rows, the non-essential
ones, widest first, are probed only for rows that can still compete. Each (shard, block of queries) returns k rows a query at
most; shards are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.common import query, table

SHARD_ROWS, BLOCK_QUERIES = 8192, 512
PROBE = 4  # non-essential terms between two looks at who still competes
HITS = "query_id long, vec_id long, score long"


class Index:
    """Postings of one shard, by term."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray):
        order = np.argsort(ids, kind="stable")  # rows in id order, so that equal scores keep the smaller id
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        row = place[row]
        by = np.lexsort((row, term))
        self.rows, self.weights, terms = row[by], weight[by], term[by]
        self.terms, heads = np.unique(terms, return_index=True)
        self.cuts = np.append(heads, len(terms))
        full = np.diff(self.cuts) == len(ids)  # a row without the term has weight 0
        self.high = np.maximum.reduceat(self.weights, heads) if len(terms) else np.zeros(0, np.int64)
        self.low = np.minimum.reduceat(self.weights, heads) if len(terms) else np.zeros(0, np.int64)
        self.high, self.low = np.where(full, self.high, np.maximum(self.high, 0)), np.where(full, self.low, np.minimum(self.low, 0))

    def search(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than `skip`; ties to the smaller id."""
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        held = (self.terms[at] == term) if len(self.terms) else np.zeros(len(term), bool)
        at, weight = at[held], weight[held]
        ends = np.stack([weight * self.low[at], weight * self.high[at]])
        width = ends.max(axis=0) - ends.min(axis=0)
        order = np.argsort(-width, kind="stable")
        at, weight, top, width = at[order], weight[order], ends.max(axis=0)[order], width[order]
        left = np.append(np.cumsum(top[::-1])[::-1], 0)  # the most that the terms from i on can add
        total = np.zeros(len(self.ids), np.int64)
        alive = np.flatnonzero(self.ids != skip)
        if len(alive) <= k:
            k = len(alive)
        if not k:
            return self.ids[:0], total[:0]

        def traverse(i: int) -> None:
            a, b = self.cuts[at[i]], self.cuts[at[i] + 1]
            total[self.rows[a:b]] += weight[i] * self.weights[a:b]

        floor = (top - width).sum()  # what every row has at least, from all terms
        # a first threshold: traverse the widest terms, then score the rows that lead
        spread = np.append(np.cumsum(width[::-1])[::-1], 0)
        i = 0
        while i < len(at) and spread[i] > spread[0] // 2:
            traverse(i)
            i += 1
        lead = alive[np.argpartition(-total[alive], k - 1)[:k]]
        bar = np.partition(total[lead] + self._probe(lead, at[i:], weight[i:]), 0)[0]
        # essential: while rows that have all their score in the rest could still reach the bar
        while i < len(at) and floor + spread[i] >= bar:
            traverse(i)
            i += 1
        while True:
            alive = alive[total[alive] + left[i] >= bar]
            if i >= len(at):
                break
            step = min(i + PROBE, len(at))
            total[alive] += self._probe(alive, at[i:step], weight[i:step])
            i = step
            if len(alive) > k:
                least = left[i] - spread[i]  # from the terms that are left
                bar = max(bar, np.partition(total[alive], len(alive) - k)[len(alive) - k] + least)
        best = alive[np.lexsort((alive, -total[alive]))[:k]]
        return self.ids[best], total[best]

    def _probe(self, rows: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What some terms add to some rows, found by binary search in the postings."""
        out = np.zeros(len(rows), np.int64)
        for t, w in zip(at, weight):
            a, b = self.cuts[t], self.cuts[t + 1]
            if b - a == len(self.ids):
                out += w * self.weights[a:b][rows]
                continue
            near = np.minimum(np.searchsorted(self.rows[a:b], rows), b - a - 1)
            out += np.where(self.rows[a:b][near] == rows, w * self.weights[a:b][near], 0)
        return out


def postings(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(id, terms, weights) from (vec_id, embedding): component i times `scale`, rounded down, is the weight of term i.

    Vectors that are null, hold a null or a number that is not finite, or have no id take no part. Zero weights are left out.
    """
    v = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    entries = F.transform("v", lambda x, i: F.struct(i.alias("t"), F.floor(x * scale).cast("long").alias("w")))
    kept = v.where(F.col("v").isNotNull() & F.col("id").isNotNull() & ~odd).select("id", F.filter(entries, lambda e: e["w"] != 0).alias("e"))
    return kept.select("id", F.col("e.t").alias("terms"), F.col("e.w").alias("weights"))


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and row, term and weight of every entry."""
    ids = t["id"].combine_chunks().to_numpy()
    terms, weights = (t[c].combine_chunks() for c in ("terms", "weights"))
    sizes = np.diff(terms.offsets.to_numpy())
    return ids, np.repeat(np.arange(len(ids)), sizes), terms.flatten().to_numpy().astype(np.int64), weights.flatten().to_numpy()


def search(rows: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of `queries` the k rows of `rows` with the largest inner product.

    Both have (id, terms, weights). A query's own id is no candidate; ties go to the smaller id; with fewer than k candidates
    all come. Rows that repeat an id are candidates of their own. Scores are exact 64-bit integers; weights must keep them there. Every row
    goes to one shard and every query to one block, both of bounded size; a task holds one of each. An empty table gives no rows.
    """
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_queries))
    part = lambda n, c: F.pmod(F.xxhash64("id", "weights"), F.lit(n)).cast("int").alias(c)
    cells = rows.select("*", part(shards, "shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), part(blocks, "block"))

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        index = Index(*_flat(left))
        ids, row, term, weight = _flat(right)
        cuts = np.searchsorted(row, np.arange(len(ids) + 1))
        asked, found, scores = [], [], []
        for i, q in enumerate(ids.tolist()):
            a, b = cuts[i], cuts[i + 1]
            best, score = index.search(term[a:b], weight[a:b], k, q)
            asked.append(np.full(len(best), q, np.int64))
            found.append(best)
            scores.append(score)
        return pa.table({"query_id": np.concatenate(asked), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    hits = cells.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(top, HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.w) + 1), lambda i: a.w[i] * b.w[i]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s) WHERE rank <= 10
"""


@query("op4_maxscore_topk", ORACLE)
def op4_maxscore_topk(spark, sf_dir):
    """The ten best of all vectors for every vector whose id is divisible by 100."""
    rows = postings(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where(F.col("id") % 100 == 0))
