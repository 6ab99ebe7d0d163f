"""Stupid-backoff language-model scores from n-gram count tables partitioned by hash.

Blocks of documents count their n-grams of all orders (map-side combine) and send every distinct one with its count to the
bucket of its name. The buckets are the count tables: they sum the counts over all blocks and answer each block for the
n-grams it asked about. An n-gram of three words or more occurs in another block only if all its pairs of words do, so blocks ask
for words and pairs first, and then only for the longer n-grams that others can hold; the count of the rest is their own.
The block joins the answers to its exploded n-grams and sums the scores per document. A document
does not vouch for itself: its own counts are taken off before it is scored. One entry a block bounds the traffic of a very
frequent n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.blocks import ASKS, COUNTS, answer_rows, answers, ask, ask_rows, conclude, deal_for, dealt, groups_of, read_replies
from tickloom.llm.common import query, table
from tickloom.llm.words import Words, mixed, window_names, window_starts, words_of

BUCKET_KEYS = 400_000
BLOCK_CHARS = 5_000_000
PAIRS = 2  # n-grams up to this order are asked for first; longer ones only where other blocks hold all their pairs
EVERYTHING = mixed(np.array([2**64 - 59], np.uint64))  # stands for all words: its count is the size of the corpus
OUT = "doc_id long, tag long, n_words long, n_backoffs long, log_score double"


def _grams(words: Words, low: int, high: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Names and texts of the n-grams of orders `low` to `high`, one order after the other, and where those of each order start."""
    names = words.names
    starts, owners = zip(*(window_starts(words.first, n) for n in range(low, high + 1)))
    return np.concatenate([window_names(names, s, n) for n, s in enumerate(starts, low)]), np.concatenate(owners), list(starts)


def _short(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams up to pairs, and EVERYTHING, with their counts."""
    keys, counts = np.unique(np.concatenate([_grams(words, 1, min(order, PAIRS))[0], EVERYTHING]), return_counts=True)
    counts[np.searchsorted(keys, EVERYTHING[0])] = len(words)
    return keys, counts


def _with_pairs(words: Words, starts: list[np.ndarray], pairs: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """For the n-grams longer than pairs, whether all their pairs have the flag."""
    here = np.zeros(len(words), bool)
    here[pairs] = flags
    return np.concatenate([np.logical_and.reduce([here[s + i] for i in range(n - 1)]) for n, s in enumerate(starts, PAIRS + 1)])


def _long(words: Words, order: int, keys: np.ndarray, counts: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams longer than pairs that other blocks can hold, for they hold all their pairs; their counts here; for each n-gram, whether it is one."""
    names, _, starts = _grams(words, PAIRS + 1, order)
    pairs = window_starts(words.first, PAIRS)[0]
    by, ordered = _ordered(window_names(words.names, pairs, PAIRS))
    at = np.searchsorted(keys, ordered)  # several times faster in order
    able = _with_pairs(words, starts, pairs[by], total[at] > counts[at])
    return *np.unique(names[able], return_counts=True), able


def _totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the counts of equal keys, for each entry."""
    order, group = groups_of(keys)
    out = np.empty(len(keys), np.int64)
    if len(keys):
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        out[order] = np.add.reduceat(counts[order], heads)[group]
    return out


def _ordered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of the names, and the names in it.

    Sorts numbers made of a name's upper bits and its place, several times faster than an argsort of names; where
    different names share those bits and come out of order, there is one.
    """
    bits = len(names).bit_length()
    packed = names >> np.uint64(bits) << np.uint64(bits) | np.arange(len(names), dtype=np.uint64)
    packed.sort()
    by = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    ordered = names[by]
    if (ordered[1:] < ordered[:-1]).any():
        by = np.argsort(names, kind="stable")
        ordered = names[by]
    return by, ordered


@dataclass
class Sorted:
    """N-grams in the stable order of their names: their places, the number of each one's name, the distinct names and their counts."""

    by: np.ndarray
    group: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    def placed(self, values: np.ndarray) -> np.ndarray:
        """Values in the order of the names, in the order of the n-grams."""
        out = np.empty(len(values), values.dtype)
        out[self.by] = values
        return out

    def left(self, owner: np.ndarray, total: np.ndarray, leave_out: bool) -> np.ndarray:
        """For each n-gram its total, given by distinct name, less the count in its own document."""
        if not leave_out:
            return self.placed(total[self.group])
        o = owner[self.by]  # texts stay in order inside equal names
        first = np.ones(len(o), bool)
        first[1:] = (self.group[1:] != self.group[:-1]) | (o[1:] != o[:-1])
        own = np.diff(np.append(np.flatnonzero(first), len(o)))
        return self.placed(total[self.group] - np.repeat(own, own))


def _sorted(names: np.ndarray) -> Sorted:
    by, ordered = _ordered(names)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(new)
    return Sorted(by, np.cumsum(new) - 1, ordered[heads], np.diff(np.append(heads, len(ordered))))


def _others(words: Words, replies: pa.Table, order: int, buckets: int, leave_out: bool) -> tuple[list[np.ndarray], int]:
    """For each order, how often the n-gram from each word on occurs in other documents, by word (0 where none starts); corpus size."""
    first, second = (replies.filter(test(replies["bucket"], buckets)) for test in (pc.less, pc.greater_equal))
    names, owner, starts = _grams(words, 1, min(order, PAIRS))
    short = _sorted(np.append(names, EVERYTHING))
    total = read_replies(first, short.keys, buckets, COUNTS)
    size = int(total[np.searchsorted(short.keys, EVERYTHING[0])])
    left = [short.left(np.append(owner, -1), total, leave_out)[:-1]]
    if order > PAIRS:
        pairs, of_pairs = starts[PAIRS - 1], slice(len(names) - len(starts[PAIRS - 1]), len(names))
        elsewhere = short.placed((total > short.counts)[short.group])[of_pairs]
        names, owner, more = _grams(words, PAIRS + 1, order)
        able = _with_pairs(words, more, pairs, elsewhere)
        near = np.flatnonzero(_with_pairs(words, more, pairs, left[0][of_pairs] > 0))  # the rest has a pair that counts nowhere
        long = _sorted(names[near])
        asked = np.zeros(len(long.keys), bool)
        asked[long.group[able[near][long.by]]] = True
        whole = long.counts  # what no other block holds occurs here only
        second = second.set_column(second.schema.get_field_index("bucket"), "bucket", pc.subtract(second["bucket"], buckets))
        whole[asked] = read_replies(second, long.keys[asked], buckets, COUNTS)
        left.append(np.zeros(len(names), np.int64))
        left[1][near] = long.left(owner[near], whole, leave_out)
        starts += more
    left, out, at = np.concatenate(left), [], 0
    for s in starts:
        here = np.zeros(len(words), np.int64)
        here[s] = left[at : at + len(s)]
        out.append(here)
        at += len(s)
    return out, size


def _score(docs: pa.Table, replies: pa.Table, order: int, alpha: float, buckets: int, leave_out: bool) -> pa.Table:
    words = words_of(docs["text"])
    n, counts = docs.num_rows, words.counts
    seen, size = _others(words, replies, order, buckets, leave_out)
    owner = words.owner()
    place = np.arange(len(words)) - words.first[:-1][owner]
    rest = (size - counts if leave_out else np.full(n, size))[owner]
    score = np.log(np.where(seen[0] > 0, seen[0], alpha) / np.maximum(rest, 1))
    backoffs = np.minimum(place, order - 1)
    score += backoffs * np.log(alpha)
    for m in range(2, order + 1):  # longer n-grams that end at the word replace shorter ones
        ends = np.flatnonzero(place >= m - 1)
        gram, context = seen[m - 1][ends - m + 1], seen[m - 2][ends - m + 1]
        known = (gram > 0) & (context > 0)  # the second holds wherever the first does, unless two names are one
        at = ends[known]
        backoffs[at] = np.minimum(place[at], order - 1) - (m - 1)
        score[at] = np.log(gram[known] / context[known]) + backoffs[at] * np.log(alpha)
    return pa.table(
        {
            "doc_id": docs["doc_id"],
            "tag": docs["tag"],
            "n_words": pa.array(counts, pa.int64()),
            "n_backoffs": pa.array(np.bincount(owner, backoffs, minlength=n).astype(np.int64)),
            "log_score": pa.array(np.bincount(owner, score, minlength=n).astype(float)),
        }
    )


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, leave_out: bool = True) -> DataFrame:
    """(doc_id, tag, n_words, n_backoffs, log_score) for every row of `docs` (doc_id, text; other columns are ignored).

    log_score sums, over the words, the natural logarithm of the longest known n-gram's relative frequency after its context, times
    alpha for each order that had to be given up; the first words of a text have shorter contexts. A word that is not known at all counts
    as alpha occurrences. With `leave_out` a document's own counts do not count. Every row is a document of its own, so repeated
    rows vouch for each other. Null and empty texts have no words and score 0; in a corpus of one document every word is unknown. Rows with
    one id are told apart by `tag`, a hash of the text. An empty table gives an empty one. N-grams are told apart by all 64 bits
    of their names: in a table of 10^10 different ones, some three pairs share a count.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    deal = deal_for(rows, block_chars=BLOCK_CHARS, bucket_keys=BUCKET_KEYS)
    buckets = deal.buckets

    def ask_short(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keys, counts = _short(words_of(t["text"]), order)
        return ask_rows(key[0].as_py(), keys, buckets, None, counts, COUNTS)

    def ask_long(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        words = words_of(t["text"])
        keys, counts = _short(words, order)
        distinct, here, _ = _long(words, order, keys, counts, read_replies(replies, keys, buckets, COUNTS))
        return ask_rows(key[0].as_py(), distinct, buckets, None, here, COUNTS)

    def reply(t: pa.Table) -> pa.Table:
        return answer_rows(t, None, _totals, COUNTS)

    def score(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        return _score(t, replies, order, alpha, buckets, leave_out)

    blocked = dealt(rows, deal)
    replies = answers(ask(blocked, ask_short), reply).repartition(deal.partitions, "block")
    if order > PAIRS:
        longer = answers(conclude(blocked, replies, ask_long, ASKS), reply).repartition(deal.partitions, "block")
        replies = replies.unionByName(longer.withColumn("bucket", F.col("bucket") + F.lit(buckets)))
    return conclude(blocked, replies, score, OUT)


@query("op7_lm_scoring")
def op7_lm_scoring(spark, sf_dir):
    """Trigram stupid-backoff scores of all documents under the counts of all others."""
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return backoff_scores(table(spark, sf_dir, "documents")).drop("tag").withColumn("mean_log_score", mean)
