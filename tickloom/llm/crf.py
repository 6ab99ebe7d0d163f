"""Linear-chain conditional random field over the words of whole texts, in numpy.

Forward-backward runs for all texts of a batch at once: every text is cut into chunks of CHUNK words, the chunks' transfer
matrices are found side by side, a scan over each text's chunks passes the messages on, and a second sweep inside the
chunks gives exact marginals. A text of any length is one chain; nothing is cut off.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickloom.llm.words import _BYTE_VALUES, Words, mixed, range_names, words_of

CHUNK = 48
BITS = 18
PREFIXES, SUFFIXES, INNER = (2, 3, 4, 5, 6), (2, 3, 4), 3
_PART = np.zeros(256, bool)  # bytes that belong to a word once its punctuation is off: digits, letters, all beyond ASCII
_PART[48:58] = _PART[65:91] = _PART[97:123] = _PART[128:] = True


def folded(texts: pa.ChunkedArray | pa.Array) -> Words:
    """Words with A-Z and the accented capitals of Latin-1 in lower case."""
    words = words_of(texts, lower=True)
    data = words.data.copy()
    second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    data[second] += 0x20
    return Words(data, words.start, words.end, words.first, words.text)


def features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words `which` (the word, its prefixes, suffixes and inner n-grams of bytes), and their owners.

    Punctuation around a word is left off; a word without letters and digits has no features.
    """
    inside = np.flatnonzero(_PART[words.data])
    if not len(inside) or not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = np.searchsorted(inside, words.start[which]), np.searchsorted(inside, words.end[which]) - 1
    ok = np.flatnonzero(hi >= lo)
    start, end = inside[lo[ok]], inside[hi[ok]] + 1
    values = _BYTE_VALUES[words.data]
    names, owners = [range_names(values, start, end)], [ok]
    for kind, sizes in ((1, PREFIXES), (2, SUFFIXES)):
        for n in sizes:
            long = np.flatnonzero(end - start >= n)
            a = start[long] if kind == 1 else end[long] - n
            names.append(mixed(range_names(values, a, a + n) + np.uint64(kind)))
            owners.append(ok[long])
    count = np.maximum(end - start - INNER + 1, 0)
    owner = np.repeat(np.arange(len(ok)), count)
    at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    names.append(mixed(range_names(values, at, at + INNER) + np.uint64(3)))
    owners.append(ok[owner])
    return (np.concatenate(names) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


def _summed(owner: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, rows[:, j], minlength=n) for j in range(rows.shape[1])], axis=1).astype(float)


def forward_backward(emit: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray):
    """(alpha, beta, potentials, transition) up to a factor for each word; marginals are proportional to alpha * beta.

    emit: log potentials (words, labels); first: bounds of the texts; start, trans: log potentials.
    """
    n, labels = emit.shape
    psi = np.exp(emit - emit.max(axis=1, keepdims=True)) + 1e-30
    move, begin = np.exp(trans - trans.max()), np.exp(start - start.max())
    counts = np.diff(first)
    chunks = -(-counts // CHUNK)
    text = np.repeat(np.arange(len(counts)), chunks)
    level = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    at = first[:-1][text] + level * CHUNK
    size = np.minimum(first[1:][text] - at, CHUNK)
    order = np.argsort(-size, kind="stable")
    text, level, at, size = text[order], level[order], at[order], size[order]
    live = np.searchsorted(-size, -np.arange(CHUNK), side="left")  # chunks with more than t words come first
    fresh = level == 0

    step = psi[at] if len(at) else np.zeros((0, labels))
    whole = np.where(fresh[:, None, None], begin, move) * step[:, None, :]
    for t in range(1, CHUNK):
        k = live[t]
        if not k:
            break
        whole[:k] = (whole[:k].reshape(-1, labels) @ move).reshape(k, labels, labels) * psi[at[:k] + t][:, None, :]
        if t % 4 == 0:
            whole[:k] /= whole[:k].max(axis=(1, 2), keepdims=True)
    if len(whole):
        whole /= whole.max(axis=(1, 2), keepdims=True)

    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(level.max(initial=-1) + 2))
    into, back = np.zeros((len(at), labels)), np.ones((len(at), labels))
    message = np.zeros((len(counts), labels))
    message[:, 0] = 1.0  # the first chunk's rows are all alike
    for a, b in zip(cuts[:-1], cuts[1:]):
        c = by_level[a:b]
        into[c] = message[text[c]]
        out = np.einsum("ci,cij->cj", into[c], whole[c])
        message[text[c]] = out / out.sum(axis=1, keepdims=True)
    message = np.ones((len(counts), labels))
    for a, b in zip(cuts[-2::-1], cuts[:0:-1]):
        c = by_level[a:b]
        back[c] = message[text[c]]
        out = np.einsum("cij,cj->ci", whole[c], back[c])
        message[text[c]] = out / out.sum(axis=1, keepdims=True)

    alpha, beta = np.empty((n, labels)), np.empty((n, labels))
    now = np.where(fresh[:, None], begin, into @ move) * step
    for t in range(CHUNK):
        k = live[t]
        if not k:
            break
        if t:
            now = (now[:k] @ move) * psi[at[:k] + t]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at[:k] + t] = now
    now = back.copy()
    for t in range(CHUNK - 1, -1, -1):
        k = live[t]
        if not k:
            continue
        more = live[t + 1] if t + 1 < CHUNK else 0  # these have a word after this one
        if more:
            now[:more] = (now[:more] * psi[at[:more] + t + 1]) @ move.T
        now[:k] /= now[:k].sum(axis=1, keepdims=True)
        beta[at[:k] + t] = now[:k]
    return alpha, beta, psi, move


@dataclass
class Tagger:
    """A fitted field: a weight for each feature and label, and log potentials of starts and transitions."""

    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray

    def emissions(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Log potentials of every word, and whether the word has features."""
        _, distinct, inverse = np.unique(words.names, return_index=True, return_inverse=True)
        index, owner = features(words, distinct)
        emit = _summed(owner, self.weights[index], len(distinct)) if len(distinct) else np.zeros((0, self.weights.shape[1]))
        return emit[inverse], (np.bincount(owner, minlength=len(distinct)) > 0)[inverse]

    def marginals(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """P(label | text) of every word, and whether the word has features."""
        emit, known = self.emissions(words)
        if not len(emit):
            return emit, known
        alpha, beta, _, _ = forward_backward(emit, words.first, self.start, self.trans)
        both = alpha * beta
        return both / both.sum(axis=1, keepdims=True), known


def fit(texts: list[str], gold: list[np.ndarray], labels: int, epochs: int = 4, batch: int = 100, rate: float = 0.2, decay: float = 1e-4, seed: int = 7) -> Tagger:
    """Maximum likelihood by AdaGrad on batches of texts; gold has the label of each word of each text."""
    tagger = Tagger(np.zeros((1 << BITS, labels)), np.zeros(labels), np.zeros((labels, labels)))
    power = [np.full_like(x, 1e-6) for x in (tagger.weights, tagger.start, tagger.trans)]
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        turns = order.permutation(len(texts))
        for some in np.array_split(turns, max(1, len(texts) // batch)):
            words = folded(pa.array([texts[i] for i in some], pa.string()))
            y = np.concatenate([gold[i] for i in some]) if len(some) else np.zeros(0, np.int64)
            if not len(y):
                continue
            _, distinct, inverse = np.unique(words.names, return_index=True, return_inverse=True)
            index, owner = features(words, distinct)
            emit = _summed(owner, tagger.weights[index], len(distinct))[inverse]
            alpha, beta, psi, move = forward_backward(emit, words.first, tagger.start, tagger.trans)
            both = alpha * beta
            miss = np.eye(labels)[y] - both / both.sum(axis=1, keepdims=True)
            per_word = _summed(inverse, miss, len(distinct))
            starts = words.first[:-1][words.counts > 0]
            inner = np.ones(len(y), bool)
            inner[starts] = False
            later = np.flatnonzero(inner)
            pair = alpha[later - 1][:, :, None] * move[None] * (psi[later] * beta[later])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            seen = np.bincount(y[later - 1] * labels + y[later], minlength=labels * labels).reshape(labels, labels)
            slopes = (
                _summed(index, per_word[owner], 1 << BITS) / len(some),
                miss[starts].sum(axis=0) / len(some),
                (seen - pair.sum(axis=0)) / len(some),
            )
            for x, g, s in zip((tagger.weights, tagger.start, tagger.trans), slopes, power):
                g = g - decay * x
                s += g * g
                x += rate * g / np.sqrt(s)
    return tagger


def slices(texts: pa.Array, limit: int = 2_000_000):
    """Bounds of runs of texts of about `limit` bytes; a longer text is a run by itself."""
    lengths = np.asarray(pc.binary_length(texts.cast(pa.large_string())).fill_null(0))
    a, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)
