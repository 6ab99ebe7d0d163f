"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time scoring.

Each task holds stretches of documents as inverted lists. A query first adds up its short lists, term at a time, into accumulators.
These then count as a single list with a known maximum. Documents are visited in windows of the document order; a window is skipped when the
largest accumulator and the largest entries of the long lists inside it cannot reach the k-th best score so far. In a window that is
not skipped, the long lists whose maxima together stay below that score are probed only for documents that can still
compete. The best k so far, and so the bar, are carried from stretch to stretch of a task; tasks are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.common import query, table
from tickloom.llm.crf import slices
from tickloom.llm.words import Words, range_names, words_of
from tickloom.session import materialize

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_TERMS = 200_000  # (item, term) pairs that are searched for together; more take further passes
WINDOW = 1024  # documents between two looks at the bounds
SHORT_PART = 32  # a list is short if it holds at most a 32nd of the stretch's documents
HITS = "item int, doc_id long, score long"
_NOT_A_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_TO_BLANK = np.where(_NOT_A_TERM, 32, np.arange(256)).astype(np.uint8)


def terms(text: str = "text") -> Column:
    """Distinct terms of a text: runs of digits, letters and all that is not ASCII; only A-Z is lower-cased."""
    return F.array_distinct(F.array_remove(F.split(F.translate(F.col(text), UPPER, LOWER), GAP), ""))


def terms_of(texts: pa.Array) -> Words:
    """The terms of a column of texts, in order and with repeats."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = _TO_BLANK[np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]]] if raw is not None else np.zeros(0, np.uint8)
    offsets = pa.py_buffer((bounds - bounds[0]).tobytes())
    return words_of(pa.Array.from_buffers(pa.large_string(), n, [None, offsets, pa.py_buffer(data.tobytes())]), lower=True)


@dataclass(frozen=True)
class Vocabulary:
    """Terms in the order of their names; their bytes lie in `data`, term i from `edge[i]` to `edge[i + 1]`."""

    names: np.ndarray
    data: np.ndarray
    edge: np.ndarray
    number: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Vocabulary:
        """`number[i]` is the place in `words` of the i-th term by name."""
        raw = [w.encode() for w in words]
        found = words_of(pa.array(words, pa.string()))
        order = np.argsort(found.names, kind="stable")
        edge = np.cumsum([0, *(len(raw[i]) for i in order)])
        return Vocabulary(found.names[order], np.frombuffer(b"".join(raw[i] for i in order), np.uint8), edge, order)

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The words that are terms, and the number of the term; names only propose, the bytes decide."""
        names = words.names
        first = np.searchsorted(self.names, names)
        first[first == len(self.names)] = 0
        at, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        live = np.flatnonzero(self.names[first] == names) if len(self.names) else np.zeros(0, np.int64)
        term = first[live]
        while len(live):  # more than once only where terms share a name
            good = self._same(words, live, term)
            at.append(live[good])
            number.append(self.number[term[good]])
            live, term = live[~good], term[~good] + 1
            on = (term < len(self.names)) & (self.names[np.minimum(term, len(self.names) - 1)] == names[live])
            live, term = live[on], term[on]
        return np.concatenate(at), np.concatenate(number)

    def _same(self, words: Words, which: np.ndarray, term: np.ndarray) -> np.ndarray:
        sizes = words.end[which] - words.start[which]
        good = sizes == self.edge[term + 1] - self.edge[term]
        near = np.flatnonzero(good)
        sizes = sizes[near]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        differ = words.data[np.repeat(words.start[which[near]], sizes) + inside] != self.data[np.repeat(self.edge[term[near]], sizes) + inside]
        good[near[np.repeat(np.arange(len(near)), sizes)[differ]]] = False
        return good


def forward_lists(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) for every row of `docs` with a term: n counts all its terms, `terms` names those of `words` it holds, by place."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.of(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        size = max(1, len(vocabulary.names))
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                found = terms_of(part.column("text"))
                at, number = vocabulary.places(found)
                keys, tf = np.unique(found.owner()[at] * size + number, return_counts=True)
                edges = np.searchsorted(keys, np.arange(b - a + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(edges, pa.array(v.astype(np.int32))) for v in (keys % size, tf)]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.counts, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(found.counts > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


class Stretch:
    """Inverted lists of some documents, with what each entry adds to a score."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int):
        ids = batch.column("doc_id")
        self.none = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        lists = batch.column("terms")
        sizes = np.diff(np.asarray(lists.offsets))
        term, tf = np.asarray(lists.flatten()).astype(np.int64), np.asarray(batch.column("tfs").flatten()).astype(np.int64)
        order = np.lexsort((self.ids, self.none))  # the order of ties
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.none = self.ids[order], self.none[order]
        row = np.repeat(place, sizes)
        m = 50 + (50 * np.asarray(batch.column("n"))[order] * n_docs) // n_terms
        by = np.lexsort((row, term))
        self.rows, term, tf = row[by], term[by], tf[by]
        self.adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.rows]))
        self.cuts = np.searchsorted(term, np.arange(len(weights) + 1))
        self.windows = np.arange(0, len(self.ids) + WINDOW, WINDOW)
        self.short = max(8, len(self.ids) // SHORT_PART)
        self._tops: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def long(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each window starts in the list of a term, and the largest entry inside; kept for the next query."""
        if t not in self._tops:
            a, b = self.cuts[t], self.cuts[t + 1]
            edges = a + np.searchsorted(self.rows[a:b], self.windows)
            top = np.zeros(len(edges) - 1, np.int64)
            full = np.flatnonzero(np.diff(edges))
            top[full] = np.maximum.reduceat(self.adds[a:b], edges[full] - a)
            self._tops[t] = edges, top
        return self._tops[t]

    def probe(self, a: int, b: int, rows: np.ndarray) -> np.ndarray:
        """What the entries a to b of one list add to some rows."""
        if a == b:
            return np.zeros(len(rows), np.int64)
        near = np.minimum(np.searchsorted(self.rows[a:b], rows), b - a - 1) + a
        return np.where(self.rows[near] == rows, self.adds[near], 0)

    def search(self, wanted: np.ndarray, best: Best) -> None:
        """Adds to `best` the documents that can be among the best for the terms `wanted`."""
        sizes = self.cuts[wanted + 1] - self.cuts[wanted]
        total = np.zeros(self.windows[-1], np.int64)
        for t in wanted[(sizes > 0) & (sizes <= self.short)]:
            a, b = self.cuts[t], self.cuts[t + 1]
            total[self.rows[a:b]] += self.adds[a:b]
        lists = [self.long(t) for t in wanted[sizes > self.short]]
        edges = np.array([e for e, _ in lists], np.int64).reshape(len(lists), len(self.windows))
        tops = np.array([t for _, t in lists], np.int64).reshape(len(lists), len(self.windows) - 1)
        bar = best.bar
        held = np.flatnonzero(total)
        if len(held) >= best.k:  # the documents that lead so far, scored in full, set a first bar
            lead = np.sort(held[np.argpartition(-total[held], best.k - 1)[: best.k]])
            full = total[lead].copy()
            for e in edges:
                full += self.probe(e[0], e[-1], lead)
            bar = max(bar, full.min())
        summed = total.reshape(-1, WINDOW).max(axis=1)
        for j in np.flatnonzero(summed + tops.sum(axis=0) >= bar):
            if summed[j] + tops[:, j].sum() < bar:
                continue
            order = np.argsort(tops[:, j], kind="stable")
            below = np.cumsum(tops[order, j])
            cut = int(np.searchsorted(below, bar))  # lists before it cannot reach the bar by themselves
            base = self.windows[j]
            score = total[base : base + WINDOW].copy()
            for i in order[cut:]:
                a, b = edges[i, j], edges[i, j + 1]
                score[self.rows[a:b] - base] += self.adds[a:b]
            rest = below[cut - 1] if cut else 0
            rows = np.flatnonzero((score > 0) & (score + rest >= bar))
            score = score[rows]
            for i in order[:cut][::-1]:
                if not len(rows):
                    break
                score += self.probe(edges[i, j], edges[i, j + 1], rows + base)
                rest -= tops[i, j]
                alive = score + rest >= bar
                rows, score = rows[alive], score[alive]
            alive = score >= bar
            rows, score = rows[alive] + base, score[alive]
            if len(rows):
                best.add(self.ids[rows], self.none[rows], score)
                bar = max(bar, best.bar)


class Best:
    """The k best documents so far; `bar` is what a further one must reach."""

    def __init__(self, k: int):
        self.k, self.bar = k, 1
        self.ids, self.none, self.scores = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, none: np.ndarray, scores: np.ndarray) -> None:
        ids, none, scores = (np.concatenate(x) for x in ((self.ids, ids), (self.none, none), (self.scores, scores)))
        keep = np.lexsort((ids, none, -scores))[: self.k]
        self.ids, self.none, self.scores = ids[keep], none[keep], scores[keep]
        if len(keep) == self.k:
            self.bar = max(self.bar, int(self.scores[-1]))


def _search_block(docs: DataFrame, wanted: list, k: int) -> DataFrame:
    """(item, doc_id, score), the k best of every task, for items numbered by place in `wanted`, a list of term lists."""
    spark = docs.sparkSession
    words = sorted({w for ws in wanted for w in ws})
    lists = materialize(forward_lists(docs, words), "forward")
    n_docs, n_terms = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(words), np.int64)
    for t, n in lists.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term
        held[t] = n
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held + 1))).astype(np.int64)
    number = {w: i for i, w in enumerate(words)}
    shared = spark.sparkContext.broadcast((weights, [np.array(sorted(number[w] for w in ws), np.int64) for ws in wanted]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = shared.value
        bests = [Best(k) for _ in queries]
        for batch in batches:
            if batch.num_rows:
                stretch = Stretch(batch, weights, n_docs, n_terms)
                for wanted, best in zip(queries, bests):
                    if len(wanted):
                        stretch.search(wanted, best)
        sizes = [len(b.ids) for b in bests]
        item = pa.array(np.repeat(np.arange(len(bests)), sizes), pa.int32())
        if len(item):
            ids, none, scores = (np.concatenate([getattr(b, f) for b in bests]) for f in ("ids", "none", "scores"))
            yield pa.RecordBatch.from_arrays([item, pa.array(ids, mask=none), pa.array(scores)], ["item", "doc_id", "score"])

    return lists.mapInArrow(search, HITS)


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) the k documents (doc_id, text) that score highest above 0.

    Terms are maximal runs of digits, ASCII letters and characters that are not ASCII, with A-Z lower-cased. With N documents that have a term, L terms in
    all, n in the document, df documents with the term and tf occurrences, a term weighs w = floor(1000 ln((2N+2)/(2df+1))) and adds
    w * (10^9 tf div (1000 tf + 20 m)), m = 50 + (50 n N div L). An item counts each of its terms once; rows that share an item_id (null is
    one too) are one item. Equal scores go by doc_id, null last; rows that repeat a doc_id are documents of their own. Null
    and empty texts have no terms: such documents are not counted, such items get no rows, as with an empty table. Other columns are ignored.
    Items are searched for in blocks of about `block_terms` terms, whose vocabulary every task holds; each block reads the documents once.
    """
    spark = docs.sparkSession
    pairs = items.select("item_id", F.explode(terms()).alias("term")).distinct()
    lists = materialize(pairs.groupBy("item_id").agg(F.collect_list("term").alias("terms")), "items")
    blocks = max(1, -(-(lists.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    lists = lists.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    hits = None
    for b in range(blocks):
        rows = lists.where(F.col("block") == b).drop("block").collect()
        if not rows:
            continue
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = _search_block(docs, [r.terms for r in rows], k).join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
        hits = found if hits is None else hits.union(found)
    if hits is None:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH t AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // total) AS m FROM d, c),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 50
"""


@query("op13_ranked_search", ORACLE)
def op13_ranked_search(spark, sf_dir):
    """The 50 best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
