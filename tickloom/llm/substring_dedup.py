"""Removal of repeated word passages, found by recompression.

Recompression replaces runs of one symbol and then chosen pairs of neighbours by new symbols, round after round. Whether
two neighbours merge depends only on the two symbols, so equal passages get equal symbols in their interior, whatever
surrounds them. A new symbol is named by hash from the names it replaces, which makes the names of all tasks agree without a
shared dictionary.

A boundary between two symbols also knows its span: the words its survival depends on. A window of `width` words is stood for by
the boundary of the highest round whose span it contains; equal windows have equal spans inside, and so choose equal
boundaries. The rest is two exchanges between blocks of documents and buckets of names (see `blocks`):

1. Which boundaries (named by round, span and place in it) occur in more than one document? One entry covers all windows that
   chose it, so this sends about a quarter of the names that all windows would need.
2. For the windows of shared boundaries only: does the same window start in a document with a smaller id? This compares
   80-bit names of the window's words and is exact but for collisions (below 1e-9 at a billion windows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.blocks import answer_rows, answers, ask, ask_rows, conclude, deal_for, dealt, holders, read_replies
from tickloom.llm.common import query, table
from tickloom.llm.words import Words, mixed, range_names, window_names, window_starts, words_of

ROUNDS = 4
KEY_BYTES = 5
WINDOW = np.dtype([("tail", "<u2"), ("doc", "<i8")])
LAST = np.iinfo(np.int64).max
OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


def _rounds(names: np.ndarray, first: np.ndarray, width: int):
    """Boundaries left by each round: (word position, first and last word of the span, exclusive) of those with a short span."""
    n = len(names)
    text_start = np.zeros(n, bool)
    text_start[first[:-1][np.diff(first) > 0]] = True
    new = text_start.copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    symbol = np.where(length > 1, mixed(names[at] + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), names[at])
    edge = text_start[at]  # starts a text: never a boundary, and nothing left of it is known
    low, high = at - 1, at + 1
    for turn in range(ROUNDS):
        if turn:
            # a boundary stays unless its left symbol falls in one half of the alphabet and its right symbol in the other
            half = (mixed(symbol + np.uint64(turn)) & np.uint64(1)).astype(bool)
            left_low = np.where(edge, -1, low)
            seen_low, seen_high = low.copy(), high.copy()
            seen_low[1:] = np.minimum(low[1:], np.where(edge[:-1], -LAST, left_low[:-1]))
            seen_high[:-1] = np.maximum(high[:-1], np.where(edge[1:], LAST, high[1:]))
            seen_high[-1:] = LAST
            merge = np.zeros(len(at), bool)
            merge[1:] = ~edge[1:] & ~half[:-1] & half[1:]
            head = np.flatnonzero(~merge)
            paired = np.append(merge[1:], False)[head]
            right = symbol[np.minimum(head + 1, len(symbol) - 1)]
            symbol = np.where(paired, mixed(symbol[head] * np.uint64(3) + mixed(right + np.uint64(turn))), symbol[head])
            at, edge, low, high = at[head], edge[head], seen_low[head], seen_high[head]
        ok = ~edge & (high - low <= width) & (low >= 0)
        yield turn, at[ok], low[ok], high[ok]


def anchors(words: Words, names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, text and chosen boundary (by name) of every window."""
    starts, owner = window_starts(words.first, width)
    n = len(names)
    if not len(starts):
        return starts, owner, np.zeros(0, np.uint64)
    here, best = np.arange(n), np.zeros(n, np.uint64)
    low, high, rank = np.full(n + width, -1), np.zeros(n + width, np.int64), np.zeros(n + width, np.uint64)
    for turn, at, lo, hi in _rounds(names, words.first, width):
        place = ((np.uint64(turn) * np.uint64(64) + (hi - lo).astype(np.uint64)) * np.uint64(64) + (at - lo).astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        name = mixed(range_names(names, lo, hi) + place)
        rank[:] = 0
        low[at], high[at] = lo, hi
        rank[at] = (np.uint64(turn + 1) << np.uint64(60)) | (name >> np.uint64(4))
        for k in range(1, width):
            fits = (low[k : k + n] >= here) & (high[k : k + n] <= here + width)
            np.maximum(best, rank[k : k + n], out=best, where=fits)
    best = best[starts]
    inside_run = best == 0  # one word repeated, no boundary at all
    best[inside_run] = names[starts[inside_run]] >> np.uint64(4)
    return starts, owner, mixed(best)


def _shared(docs: pa.Table, replies: pa.Table, width: int, buckets: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows whose boundary occurs in more than one document: their start, text, name and the name's tail."""
    words = words_of(docs["text"])
    names = words.names
    starts, owner, chosen = anchors(words, names, width)
    own, inverse = np.unique(chosen, return_inverse=True)
    many = read_replies(replies, own, buckets, np.uint32) > 1
    some = np.full(len(own), -1)
    some[inverse] = owner
    many[inverse[some[inverse] != owner]] = True
    keep = many[inverse]
    starts, owner = starts[keep], owner[keep]
    tail = (window_names(names, starts, width, second=True) >> np.uint64(48)).astype(np.uint16)
    return words, starts, owner, window_names(names, starts, width), tail


def _ids(docs: pa.Table) -> np.ndarray:
    return docs["doc_id"].combine_chunks().cast(pa.int64()).fill_null(LAST).to_numpy()


def _first_holders(ids: np.ndarray, owner: np.ndarray, name: np.ndarray, tail: np.ndarray):
    """Distinct windows in order, the group of each window, and the smallest id in this block that holds it."""
    order = np.lexsort((ids[owner], tail, name))
    new = np.ones(len(order), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (tail[order][1:] != tail[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    head = order[new]
    return name[head], tail[head], group, ids[owner[head]]


def _smaller_elsewhere(keys: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Does another block hold the window with a smaller id?"""
    order = np.lexsort((extra["doc"], extra["tail"], keys))
    k, t = keys[order], extra["tail"][order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    doc = extra["doc"][order]
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc
    out = np.zeros(len(order), bool)
    out[order] = least < doc
    return out


def _remove(docs: pa.Table, replies: pa.Table, width: int, buckets: int) -> pa.Table:
    first, second = (replies.filter(pc.equal(replies["step"], s)) for s in (1, 2))
    words, starts, owner, name, tail = _shared(docs, first, width, buckets)
    ids = _ids(docs)
    names, _, group, least = _first_holders(ids, owner, name, tail)
    smaller = read_replies(second, names, buckets, bool)
    hit = starts[smaller[group] | (least[group] < ids[owner])]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    gone = np.cumsum(cover)[:-1] > 0
    n = docs.num_rows
    sums = np.concatenate(([0], np.cumsum(gone)))[words.first]
    kept, spans, lengths = [], [], []
    for i in range(n):
        a, b = words.first[i], words.first[i + 1]
        here = words.bytes_of(i)
        if sums[i + 1] > sums[i]:
            out = gone[a:b]
            here = [w for w, g in zip(here, out.tolist()) if not g]
            turn = np.flatnonzero(np.diff(np.concatenate(([False], out, [False]))))
            spans.append(turn.reshape(-1, 2))
            lengths.append(len(turn) // 2)
        else:
            lengths.append(0)
        kept.append(b" ".join(here))
    pairs = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
    ranges = pa.StructArray.from_arrays([pa.array(pairs[:, 0], pa.int32()), pa.array(pairs[:, 1], pa.int32())], ["start", "end"])
    cuts = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
    return pa.table(
        {
            "doc_id": docs["doc_id"],
            "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(np.diff(sums), pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            "removed": pa.ListArray.from_arrays(cuts, ranges),
        }
    )


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed) for every row of `docs` (doc_id, text; other columns are ignored).

    A word goes if a window of `width` words covers it whose word sequence also starts in a document with a smaller doc_id;
    windows are judged on the input. kept_text has the kept words joined by one space, removed the word ranges that went. Null
    and empty texts have no words and an empty kept_text; shorter texts have no window and stay. Rows with one doc_id do not count as smaller than
    each other, so repeated rows stay; a null doc_id is larger than all others. An empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    deal = deal_for(rows)
    buckets = deal.buckets

    def ask_boundaries(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        words = words_of(t["text"])
        return ask_rows(key[0].as_py(), np.unique(anchors(words, words.names, width)[2]), buckets, KEY_BYTES)

    def count_holders(t: pa.Table) -> pa.Table:
        return answer_rows(t, KEY_BYTES, holders)

    def ask_windows(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        _, _, owner, name, tail = _shared(t, replies, width, buckets)
        names, tails, _, least = _first_holders(_ids(t), owner, name, tail)
        extra = np.empty(len(names), WINDOW)
        extra["tail"], extra["doc"] = tails, least
        return ask_rows(key[0].as_py(), names, buckets, 8, extra)

    def compare_windows(t: pa.Table) -> pa.Table:
        return answer_rows(t, 8, _smaller_elsewhere, WINDOW)

    def remove(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        return _remove(t, replies, width, buckets)

    blocked = dealt(rows, deal)
    held = answers(ask(blocked, ask_boundaries), count_holders)
    asked = conclude(blocked, held, ask_windows, "bucket int, block int, keys binary, extra binary")
    both = held.withColumn("step", F.lit(1)).union(answers(asked, compare_windows).withColumn("step", F.lit(2)))
    return conclude(blocked, both, remove, OUT)


ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT gram, min(doc_id) AS m FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
h AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN f USING (gram) WHERE f.m < g.doc_id),
hs AS (SELECT doc_id, list(p) AS ps FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN hs USING (doc_id)
"""


@query("op3_substring_dedup", ORACLE)
def op3_substring_dedup(spark, sf_dir):
    """Passages of 13 words and more that also start in a document with a smaller id, removed from all documents."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
