"""Toxic spans and document scores: a conditional random field tags words, its marginals are summed up per document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import query, table
from tickloom.llm.crf import _PART, Tagger, fit, folded, slices
from tickloom.llm.language_id import held_out, stretches
from tickloom.llm.words import Words, window_names, window_starts

SAMPLE_TOXIC, SAMPLE_CLEAN = 1_200, 2_400  # labelled texts to learn from
SAMPLE_CHARS = 8_000  # of one of them
STEMS = (3, 4, 5, 6)
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS = 4, 0.01, 25.0
LAST = np.uint64(2**64 - 1)
OUT = "doc_id long, tag long, score double, spans array<struct<start:int,end:int,chance:double>>"


@dataclass
class Detector:
    """The word tagger, and the logistic curve that turns a text's marginals into its score."""

    tagger: Tagger
    curve: np.ndarray


def _bare(words: Words) -> list[bytes]:
    """Words without the punctuation around them."""
    inside = np.flatnonzero(_PART[words.data])
    if not len(inside):
        return [b""] * len(words)
    lo, hi = np.searchsorted(inside, words.start), np.searchsorted(inside, words.end) - 1
    raw = words.data.tobytes()
    return [raw[inside[a] : inside[b] + 1] if b >= a else b"" for a, b in zip(lo.tolist(), hi.tolist())]


def _units(word: bytes) -> list[bytes]:
    """The word and its first 3 to 6 characters."""
    text = word.decode("utf-8", "replace")
    return [b"=" + word, *(b"<" + text[:n].encode() for n in STEMS if len(text) > n)]


def label_words(texts: list[str], toxic: np.ndarray) -> list[np.ndarray]:
    """1 for words of toxic texts that, as a word or by their stem, mark toxic texts; 0 for all others.

    A word or stem marks them if it is in at least LEAST_TEXTS and LEAST_SHARE of the toxic texts and its smoothed odds there are
    LEAST_ODDS times those in clean texts. Texts with the same smallest
    five-word hash, copies for the most part, count once.
    """
    same: dict[bytes, bytes] = {}  # one object for each distinct word
    words: list[list[bytes]] = []
    groups: dict[tuple[int, int], set[bytes]] = {}
    for text, y in zip(texts, toxic):
        w = folded(pa.array([text], pa.string()))
        words.append([same.setdefault(x, x) for x in _bare(w)])
        width = min(5, max(1, len(w)))
        least = int(window_names(w.names, window_starts(w.first, width)[0], width).min(initial=LAST))
        groups.setdefault((least, int(y)), set()).update(words[-1])
    units: dict[bytes, list[bytes]] = {b"": []}
    seen = (Counter(), Counter())
    for (_, y), own in groups.items():
        for word in [w for w in own if w not in units]:
            units[word] = _units(word)
        seen[y].update({u for w in own for u in units[w]})
    n = [max(1, sum(y == k for _, y in groups)) for k in (0, 1)]
    marks = {u for u, c in seen[1].items() if c >= max(LEAST_TEXTS, LEAST_SHARE * n[1]) and (c + 0.5) / n[1] >= LEAST_ODDS * (seen[0][u] + 0.5) / n[0]}
    known: dict[bytes, int] = {b"": 0}
    out = []
    for some, y in zip(words, toxic):
        if not y:
            out.append(np.zeros(len(some), np.int64))
            continue
        for w in {w for w in some if w not in known}:
            known[w] = int(any(u in marks for u in units[w]))
        out.append(np.array([known[w] for w in some], np.int64))
    return out


def _summary(chance: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each text: a constant, the largest marginal, the expected number of toxic words on a log scale."""
    most = np.zeros(n)
    if len(chance):
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        most[owner[heads]] = np.maximum.reduceat(chance, heads)
    sure = np.where(chance > 0.05, chance, 0.0)  # the many words that are hardly toxic must not add up in long texts
    return np.stack([np.ones(n), most, np.log1p(np.bincount(owner, sure, minlength=n))], axis=1)


def _text_summary(tagger: Tagger, texts: pa.Array) -> tuple[np.ndarray, Words, np.ndarray]:
    words = folded(texts)
    chance = tagger.marginals(words)[0][:, 1]
    return _summary(chance, words.owner(), len(texts)), words, chance


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, halved until they help, with a small ridge."""
    weight = weight / weight.sum() * len(y)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z)) + 0.05 * float(w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.1 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN, chars: int = SAMPLE_CHARS) -> Detector:
    """A detector from `docs` (doc_id, text) and `labels` (doc_id, toxic); rows without a label or text are left out.

    It is fitted on at most about n_toxic + n_clean labelled texts, drawn by a hash of the text; equal texts with one label count
    once, and of a text above `chars` characters stretches are taken. The classes of the draw are weighted back to their shares of
    all labelled texts. With one class only, every score is that class's share.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = docs.select("doc_id", "text", F.xxhash64("text", F.lit("draw")).alias("h")).where(F.length("text") > 0)
    distinct = usable.select("doc_id", "h").join(known, "doc_id").groupBy("toxic", "h").agg(F.count(F.lit(1)).alias("c"))
    count = {r[0]: r[1:] for r in distinct.groupBy("toxic").agg(F.count(F.lit(1)), F.sum("c")).collect()}
    share = {y: min(1.0, n / count[y][0]) if y in count else 1.0 for y, n in ((0, n_clean), (1, n_toxic))}
    turn = (F.pmod("h", F.lit(1_000_000)) / 1e6) / F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    drawn = distinct.withColumn("turn", turn).where("turn < 1").orderBy("turn", "toxic", "h").limit(2 * (n_toxic + n_clean))
    # the draw is bounded, so the texts are not moved to find it
    found = usable.join(F.broadcast(drawn.select("toxic", "h")), "h").select("toxic", "h", stretches(F.col("text"), chars).alias("text"))
    got = sorted((r["text"], r["toxic"]) for r in found.groupBy("toxic", "h").agg(F.min("text").alias("text")).collect())
    texts, y = [t for t, _ in got], np.array([v for _, v in got], np.int64)
    if not len(y):
        return Detector(fit([], [], 2), np.array([-30.0, 0.0, 0.0]))
    tagger = fit(texts, label_words(texts, y), 2)
    column = pa.array(texts, pa.string())
    x = np.concatenate([_text_summary(tagger, column.slice(a, b - a))[0] for a, b in slices(column, 500_000)])
    each = {k: count[k][1] / n for k, n in zip(*np.unique(y, return_counts=True))}
    return Detector(tagger, _curve(x, y, np.array([each[k] for k in y])))


def detect(docs: DataFrame, detector: Detector, least: float = 0.5) -> DataFrame:
    """(doc_id, tag, score, spans) for every row of `docs` (doc_id, text; other columns are ignored).

    score is the chance that the text is toxic; spans are character ranges of runs of words whose marginal is at least `least`,
    with the largest marginal of the run. Null and empty texts get the score of a text without toxic words and no spans. Rows with one id are
    told apart by `tag`, a hash of the text; repeated rows come back as often as they came. An empty table gives an empty one.
    """
    t = detector.tagger
    shared = docs.sparkSession.sparkContext.broadcast((t.weights.astype(np.float32), t.start, t.trans, detector.curve))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start, trans, curve = shared.value
        model = Tagger(weights, start, trans)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                x, words, chance = _text_summary(model, part.column("text"))
                owner, n = words.owner(), b - a
                scores = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
                toxic = np.flatnonzero(chance >= least)
                new = np.ones(len(toxic), bool)
                new[1:] = (np.diff(toxic) > 1) | (owner[toxic][1:] != owner[toxic][:-1])
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(toxic))[: len(heads)] - 1
                own = owner[toxic[heads]]
                # characters before a byte: bytes that start a character, counted from the text's own start
                chars = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
                base = chars[words.text[own]]
                begin, end = chars[words.start[toxic[heads]]] - base, chars[words.end[toxic[tails]]] - base
                most = np.maximum.reduceat(chance[toxic], heads) if len(heads) else np.zeros(0)
                runs = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(most)], ["start", "end", "chance"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), runs)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array(scores), spans], ["doc_id", "tag", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text").mapInArrow(score, OUT)


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    """Toxicity of all documents, learned from the labelled ones of the folds other than 0 of 5."""
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    out = detect(docs, learn(docs.where(~held_out(5, 0)), labels.where(~held_out(5, 0))))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
