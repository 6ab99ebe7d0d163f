"""Tokens per section, from one encoding of the whole document.

A document is encoded once. Its tokens are byte ranges that follow each other without gaps (byte-level merges), and an
interval join in range order gives each section its tokens. A token that touches two sections, or a section and what
lies between sections, is allocated by a rule:

* most: whole to the section that holds most of its bytes, ties to the earlier one
* start: whole to the section that holds its first byte
* split: to every section by its share of the token's bytes

Under each rule, what no section gets belongs to section -1, so a document's rows add up to its tokens.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import query, table
from tickloom.llm.crf import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("most", "start", "split")
OUT = "doc_id long, tag long, section int, start int, end int, n_tokens double, n_crossing int"


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    """The encoder of a rank file, and the number of bytes of each token."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def allocate(tokens: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens and crossing tokens of each section [begin, end), and the tokens of none.

    tokens: bounds of the tokens; sections are sorted and do not overlap.
    """
    left, right = tokens[:-1], tokens[1:]
    first = np.searchsorted(end, left, side="right")  # the first section that ends after the token starts
    last = np.searchsorted(begin, right, side="left")  # one past the last that starts before the token ends
    touched = np.maximum(last - first, 0)
    owner = np.repeat(np.arange(len(left)), touched)
    section = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(touched) - touched, touched)
    shared = np.minimum(right[owner], end[section]) - np.maximum(left[owner], begin[section])
    ok = shared > 0  # empty sections touch nothing
    owner, section, shared = owner[ok], section[ok], shared[ok]
    part = shared / (right - left)[owner]
    if rule == "split":
        weight = part
    elif rule == "start":
        weight = ((begin[section] <= left[owner]) & (left[owner] < end[section])).astype(float)
    else:
        best = np.lexsort((section, -shared, owner))
        weight = np.zeros(len(owner))
        weight[best[np.flatnonzero(np.diff(owner[best], prepend=-1))]] = 1.0
    counts = np.bincount(section, weight, minlength=len(begin))
    crossing = np.bincount(section[part < 1], minlength=len(begin))
    return counts, crossing, float(len(left) - weight.sum())


def line_sections(data: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the lines that are not empty, without their line ends."""
    breaks = np.flatnonzero(data[first:last] == 10) + first
    begin, end = np.append(first, breaks + 1), np.append(breaks, last)
    return begin[end > begin], end[end > begin]


def section_tokens(docs: DataFrame, sections: DataFrame | None = None, rule: str = "most", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tag, section, start, end, n_tokens, n_crossing): one row for each section, and section -1 (start and end null).

    `docs` has (doc_id, text); `sections` (doc_id, start, end) in characters, end exclusive, not overlapping; without it every line that is
    not empty is a section. Sections are numbered by start; parts of a section outside the text are cut off. n_crossing counts
    the tokens that only partly lie in the section. Null and empty texts have a row -1 with 0 tokens, and their sections 0. Sections
    with a null bound are left out, and those with a null or unknown doc_id. Rows that repeat an id are told apart by `tag`, a hash of the
    text. Other columns are ignored. An empty table gives an empty one.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    if sections is not None:
        given = sections.where("doc_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
        lists = given.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("start", "end")]))).alias("given"))
        rows = rows.join(lists, "doc_id", "left").select("doc_id", "tag", "text", "given")
    lines = sections is None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoding(vocabulary)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                columns: list[list] = [[] for _ in range(5)]
                row = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    raw = (text or "").encode()
                    data = np.frombuffer(raw, np.uint8)
                    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters begun before each byte
                    if lines:
                        begin, end = line_sections(data, 0, len(data))
                    else:
                        given = part.column("given")[i].as_py() or []
                        heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                        begin, end = (heads[np.clip([s[c] for s in given], 0, len(heads) - 1).astype(np.int64)] for c in ("start", "end"))
                    tokens = np.concatenate(([0], np.cumsum(sizes[np.asarray(encoding.encode_ordinary(text or ""), np.int64)])))
                    counts, crossing, none = allocate(tokens, begin, end, rule)
                    row += [i] * (len(begin) + 1)
                    for column, values, rest in zip(
                        columns,
                        (np.arange(len(begin)), chars[begin], chars[end], counts, crossing),
                        (-1, None, None, none, 0),
                    ):
                        column += [*values.tolist(), rest]
                row = pa.array(row, pa.int64())
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                arrays = [part.column("doc_id").take(row), part.column("tag").take(row), *(pa.array(c, k) for c, k in zip(columns, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "tag", "section", "start", "end", "n_tokens", "n_crossing"])

    return rows.mapInArrow(count, OUT)


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    """Tokens of every line of all documents; a token across a line's end goes to where most of it lies."""
    return section_tokens(table(spark, sf_dir, "documents")).drop("tag")
