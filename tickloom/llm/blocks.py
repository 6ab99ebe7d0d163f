"""Ask-and-answer exchange of packed keys between blocks of documents and buckets of keys.

Documents are dealt into blocks of bounded text by a hash of the whole row. A block sends every distinct key it
holds once (so a key that occurs in a third of all documents sends one entry a block, not one a document), packed into one
row per bucket of the key range. A bucket answers each block with one array aligned to the keys it asked about, and the
block, computed again from the same reused shuffle, reads the answers by position. Both sides are bounded: blocks by
characters, buckets by keys. Nothing depends on the order of rows, so a task that runs again gives the same keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK_CHARS = 3_000_000
BUCKET_KEYS = 1_500_000
ASKS = "bucket int, block int, keys binary, extra binary"
ANSWERS = "block int, bucket int, reply binary"


@dataclass(frozen=True)
class Deal:
    blocks: int
    buckets: int
    partitions: int


def deal_for(docs: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS, bucket_keys: int = BUCKET_KEYS) -> Deal:
    """Numbers of blocks and buckets for all of `docs`, from one aggregate."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    return Deal(max(2 * partitions, -(-chars // block_chars)), max(partitions, -(-chars // 6 // bucket_keys)), partitions)


def dealt(docs: DataFrame, deal: Deal) -> DataFrame:
    """`docs` with its block. Rows are spread by id and text, so null or repeated ids do not meet."""
    block = F.pmod(F.xxhash64(*docs.columns), F.lit(deal.blocks)).cast("int")
    return docs.withColumn("block", block).repartition(deal.partitions, "block")


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Cuts of sorted 64-bit keys into `buckets` equal ranges of the key space."""
    inner = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(inner, np.uint64)), [len(keys)])).astype(np.int64)


def pack(keys: np.ndarray, size: int) -> np.ndarray:
    """The low `size` bytes of each key. The high bits name the bucket, so more buckets lengthen the whole name."""
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]


def whole_bytes(buckets: int) -> int:
    """How many low bytes of a key tell all 64-bit keys of one bucket apart."""
    return -(-((2**64 - 1) // buckets).bit_length() // 8)


def unpack(blob: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(blob) // size, 8), np.uint8)
    out[:, :size] = blob.reshape(-1, size)
    return out.view("<u8").reshape(-1)


COUNTS = "counts"  # the kind of entries that are counts: most of them take less than a byte


def shortened(counts: np.ndarray) -> bytes:
    """One byte for each count, and eight more for those that do not fit; compressed, since most are small."""
    plain = np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def lengthened(blob: bytes, n: int) -> np.ndarray:
    plain = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    out = np.frombuffer(plain, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(plain, "<i8", offset=n)
    return out


GAP_BYTES = 5  # of a sorted key, so many low bytes are packed as they are; what is above them goes as steps, most of less than a byte


def gapped(places: np.ndarray) -> bytes:
    """Sorted 64-bit numbers, whole: how many, their low bytes, and the steps from one to the next of what is above these."""
    steps = np.diff((places >> np.uint64(8 * GAP_BYTES)).astype(np.int64), prepend=0)
    return len(places).to_bytes(4, "little") + pack(places, GAP_BYTES).tobytes() + shortened(steps)


def ungapped(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    low = unpack(np.frombuffer(blob, np.uint8, n * GAP_BYTES, 4), GAP_BYTES)
    return low | np.cumsum(lengthened(blob[4 + n * GAP_BYTES :], n)).astype(np.uint64) << np.uint64(8 * GAP_BYTES)


def ask_rows(block: int, keys: np.ndarray, buckets: int, size: int | None, extra: np.ndarray | None = None, kind: object = None) -> pa.Table:
    """One row per bucket for the sorted distinct `keys`; `extra` has one entry per key, of fixed width or COUNTS.

    With `size` None the keys are sent whole, as steps from one to the next.
    """
    edges = bucket_edges(keys, buckets)
    packed = keys if size is None else pack(keys, size)
    used = np.flatnonzero(np.diff(edges))
    whole = shortened if kind == COUNTS else np.ndarray.tobytes
    part = lambda a, b, as_bytes=np.ndarray.tobytes: as_bytes(a[edges[b] : edges[b + 1]])
    return pa.table(
        {
            "bucket": pa.array(used, pa.int32()),
            "block": pa.array(np.full(len(used), block), pa.int32()),
            "keys": pa.array([gapped(packed[edges[b] : edges[b + 1]] - np.uint64((int(b) << 64) // buckets)) if size is None else part(packed, b) for b in used], pa.binary()),
            "extra": pa.array([None if extra is None else part(extra, b, whole) for b in used], pa.binary()),
        }
    )


def answer_rows(asked: pa.Table, size: int | None, answer: Callable[[np.ndarray, np.ndarray], np.ndarray], entry: np.dtype | str | None = None) -> pa.Table:
    """`answer(keys, extra)` gives one value for each key of the bucket; they go back to the blocks that asked.

    `entry` is the type of the extra entries; with COUNTS the answers are counts as well.
    """
    blobs = asked["keys"].to_pylist()
    if size is None:
        lists = [ungapped(b) for b in blobs]
        keys, sizes = np.concatenate(lists), [len(x) for x in lists]
    else:
        keys = unpack(np.frombuffer(b"".join(blobs), np.uint8), size)
        sizes = [len(b) // size for b in blobs]
    if entry == COUNTS:
        extra = np.concatenate([lengthened(x, n) for x, n in zip(asked["extra"].to_pylist(), sizes)])
    else:
        extra = np.frombuffer(b"".join(asked["extra"].to_pylist()), entry) if entry is not None else keys
    parts = np.split(answer(keys, extra), np.cumsum(sizes)[:-1])
    replies = [shortened(v) if entry == COUNTS else (np.packbits(v) if v.dtype == bool else v).tobytes() for v in parts]
    return pa.table({"block": asked["block"], "bucket": asked["bucket"], "reply": pa.array(replies, pa.binary())})


def read_replies(replies: pa.Table, keys: np.ndarray, buckets: int, dtype: type | str) -> np.ndarray:
    """One value per sorted distinct key, from the replies to this block."""
    edges = bucket_edges(keys, buckets)
    out = np.zeros(len(keys), np.int64 if dtype == COUNTS else dtype)
    for bucket, reply in zip(replies["bucket"].to_pylist(), replies["reply"].to_pylist()):
        a, b = edges[bucket], edges[bucket + 1]
        if dtype == COUNTS:
            out[a:b] = lengthened(reply, b - a)
            continue
        raw = np.frombuffer(reply, np.uint8)
        out[a:b] = np.unpackbits(raw, count=b - a).astype(bool) if dtype is bool else raw.view(dtype)
    return out


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and the number of the group of equal keys at each sorted place."""
    order = np.argsort(keys)
    new = np.zeros(len(keys), np.int64)
    new[1:] = keys[order][1:] != keys[order][:-1]
    return order, np.cumsum(new)


def holders(keys: np.ndarray, _: np.ndarray) -> np.ndarray:
    """How many blocks hold each key."""
    if not len(keys):
        return np.zeros(0, np.uint32)
    order, group = groups_of(keys)
    out = np.empty(len(keys), np.uint32)
    out[order] = np.bincount(group).astype(np.uint32)[group]
    return out


def ask(blocked: DataFrame, asks: Callable[[tuple, pa.Table], pa.Table]) -> DataFrame:
    return blocked.groupBy("block").applyInArrow(asks, ASKS)


def answers(asked: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return asked.groupBy("bucket").applyInArrow(answer, ANSWERS)


def conclude(blocked: DataFrame, replies: DataFrame, conclusion: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocked.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(conclusion, schema)
