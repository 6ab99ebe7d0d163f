"""Text vectors: cache, batch encoding, lookup, and session/company aggregates.

Vectors are `array<float>` and are summed in double, one array buffer per group, with map-side combine.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.text import vector_text
from tickloom.operators.events import session_last_bar, timing_flags
from tickloom.session import materialize

Encoder = Callable[[list[str]], np.ndarray]


def distinct_texts(texts: DataFrame) -> DataFrame:
    return texts.select("text").where(F.col("text").isNotNull() & (F.col("text") != "")).distinct()


def missing_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct non-empty texts without a cached vector."""
    return distinct_texts(texts).join(cache.select("text"), "text", "left_anti")


def merge_cache(cache: DataFrame, added: DataFrame) -> DataFrame:
    """Cache with new vectors; a text in both keeps the new one."""
    kept = cache.dropDuplicates(["text"]).join(added.select("text"), "text", "left_anti")
    return kept.unionByName(added.dropDuplicates(["text"]))


def encode(texts: DataFrame, encoder: Callable[[], Encoder], batch_size: int = 128, normalize: bool = True) -> DataFrame:
    """(text, embedding) through a caller's encoder, one instance per task, in fixed batches.

    `encoder` is a factory run inside the task; it returns a function from texts to a 2-d array.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or encoder()
            values = pdf["text"].tolist()
            for start in range(0, len(values), batch_size):
                chunk = values[start : start + batch_size]
                vectors = np.asarray(model(chunk), dtype=np.float64)
                if normalize:
                    length = np.linalg.norm(vectors, axis=1, keepdims=True)
                    vectors = vectors / np.where(length > 0, length, 1.0)
                yield pd.DataFrame({"text": chunk, "embedding": list(vectors.astype(np.float32))})

    return texts.select("text").mapInPandas(run, "text string, embedding array<float>")


def embed_texts(
    texts: DataFrame, cache: DataFrame, encoder: Callable[[], Encoder], batch_size: int = 128, normalize: bool = True
) -> DataFrame:
    """The cache completed for all given texts; only missing texts are encoded."""
    missing = missing_texts(texts, cache)
    return merge_cache(cache, encode(missing, encoder, batch_size, normalize))


CACHE_BUCKETS = 64
CACHE = "text string, embedding array<float>, key long, version long, bucket int"
FEW_TEXTS = 1000  # so many keys are looked for by value; the files' Bloom filters and ranges then skip what lacks them


def _keyed(texts: DataFrame) -> DataFrame:
    """`texts` with the hash that orders the cache, and its folder."""
    keyed = texts.withColumn("key", F.xxhash64("text"))
    return keyed.withColumn("bucket", F.pmod("key", F.lit(CACHE_BUCKETS)).cast("int"))


def _cache_files(spark: SparkSession, path: str) -> DataFrame:
    """All rows under `path`, older versions too; none where nothing was written yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text").agg(F.max_by("embedding", "version").alias("embedding"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(text, embedding) of the whole cache, the last vector of each text."""
    return _latest(_cache_files(spark, path))


def append_cache(path: str, vectors: DataFrame) -> None:
    """Add (text, embedding) rows, which replace earlier ones of the same texts.

    Files lie in a folder for each bucket of the text's hash, sorted by it, with Bloom filters of it.
    """
    rows = _keyed(vectors.select("text", "embedding")).withColumn("version", F.lit(time.time_ns()))
    _write_cache(rows, path, "append")


def _write_cache(rows: DataFrame, path: str, mode: str) -> None:
    writer = rows.select("text", "embedding", "key", "version", "bucket").repartition(CACHE_BUCKETS, "bucket").sortWithinPartitions("bucket", "key").write
    options = {"parquet.bloom.filter.enabled#key": "true", "partitionOverwriteMode": "dynamic"}
    writer.mode(mode).options(**options).partitionBy("bucket").parquet(path)


def stored_rows(path: str, texts: DataFrame) -> DataFrame:
    """The cache's rows that can hold the given texts: their folders only, and for few texts only the row groups with their hashes."""
    spark = texts.sparkSession
    wanted = _keyed(distinct_texts(texts))
    rows = _cache_files(spark, path)
    buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # CACHE_BUCKETS at most
    if len(buckets) < CACHE_BUCKETS:
        rows = rows.where(F.col("bucket").isin(buckets))
    few = wanted.select("key").limit(FEW_TEXTS + 1).collect()
    return rows.where(F.col("key").isin([r["key"] for r in few])) if len(few) <= FEW_TEXTS else rows


def cached(path: str, texts: DataFrame) -> DataFrame:
    """(text, embedding) of those of the given texts that the cache holds, without reading the rest of it where they are few."""
    return _latest(stored_rows(path, texts).join(distinct_texts(texts), "text", "left_semi"))


def update_cache(path: str, texts: DataFrame, encoder: Callable[[], Encoder], batch_size: int = 128, normalize: bool = True) -> DataFrame:
    """Encode the texts that the cache lacks, append them to it, and return the cache; `cached` gives those of some texts.

    Of the cache only what can hold the given texts is read.
    """
    missing = materialize(distinct_texts(texts).join(stored_rows(path, texts).select("text"), "text", "left_anti"), "missing")
    if missing.limit(1).count():
        append_cache(path, encode(missing, encoder, batch_size, normalize))
    return read_cache(texts.sparkSession, path)


def compact_cache(spark: SparkSession, path: str) -> int:
    """Rewrite the folders that hold a text more than once, keeping its last vector; returns the rows dropped.

    Clean folders are not touched. The new rows are written to the shared folder first, then replace the folders one by one.
    """
    rows = _cache_files(spark, path)
    repeated = rows.groupBy("bucket", "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dirty = {r["bucket"]: r["extra"] for r in repeated.groupBy("bucket").agg(F.sum(F.col("n") - 1).alias("extra")).collect()}
    if dirty:
        old = rows.where(F.col("bucket").isin(list(dirty)))
        last = old.groupBy("text", "key", "bucket").agg(F.max_by("embedding", "version").alias("embedding"), F.max("version").alias("version"))
        _write_cache(materialize(last, "compacted"), path, "overwrite")
    return sum(dirty.values())


def hashed_words(dims: int = 64) -> Encoder:
    """Default encoder without a model: signed hashed word counts. md5 gives the same vectors in every engine."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in enumerate(texts):
            for word in text.split(" "):
                if word:
                    digest = hashlib.md5(word.encode()).hexdigest()
                    out[row, int(digest[:7], 16) % dims] += 1.0 if int(digest[7], 16) % 2 else -1.0
        return out

    return run


def hashed_vectors(texts: DataFrame, dims: int = 64) -> DataFrame:
    """Vectors of the default encoder for all distinct texts."""
    return encode(distinct_texts(texts), partial(hashed_words, dims))


def dimensions(vectors: DataFrame) -> int:
    """The one length of all vectors; 0 without vectors."""
    low, high = vectors.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != high:
        raise ValueError(f"Vectors have between {low} and {high} dimensions.")
    return int(low or 0)


def lookup(rows: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """Rows with a `text` column ⟕ vectors; unknown or empty texts get the zero vector."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dims)
    return rows.join(vectors, "text", "left").withColumn("embedding", F.coalesce("embedding", zero))


def text_cells(parsed: DataFrame, source: str, keys: Sequence[str]) -> DataFrame:
    """Headlines counted per (keys, bar, text), so a text repeated a million times meets its vector once."""
    return (
        parsed.select(*dict.fromkeys(["session", *keys]), "bar_ix", vector_text(source).alias("text"))
        .groupBy(*dict.fromkeys(["session", *keys]), "bar_ix", "text")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )


def _array_sum(values: Column) -> Column:
    """Element-wise sum of equally long arrays: one buffer of doubles per group, combined before the shuffle."""
    return vector_to_array(Summarizer.sum(array_to_vector(values)))


def _scaled(values: Column, factor: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double") * factor)


def _named(values: str, names: Sequence[str]) -> list[Column]:
    return [F.col(values)[i].alias(n) for i, n in enumerate(names)]


def _mean_arrays(parsed: DataFrame, vectors: DataFrame, source: str, dims: int, keys: list[str]) -> DataFrame:
    """(keys, means): the plain mean vector followed by the recency-weighted one."""
    cells = text_cells(parsed, source, keys)
    per_text = (
        cells.join(session_last_bar(cells), "session")
        .withColumn("recent", F.col("n") * timing_flags()["is_recent"])
        .groupBy(*keys, "text")
        .agg(F.sum("n").alias("n"), F.sum("recent").alias("recent"))
    )
    found = lookup(per_text, vectors, dims)
    both = F.concat(_scaled(F.col("embedding"), F.col("n")), _scaled(F.col("embedding"), F.col("recent")))
    sums = found.withColumn("both", both).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.greatest(F.sum("recent"), F.lit(1e-9)).alias("recent"), _array_sum(F.col("both")).alias("both")
    )
    means = F.transform("both", lambda x, i: x / F.when(i < dims, F.col("n")).otherwise(F.col("recent")))
    return sums.select(*keys, means.alias("means"))


def _mean_names(dims: int) -> list[str]:
    return [f"{p}emb_{i:03d}" for p in ("", "recent_") for i in range(dims)]


def mean_and_recent(
    parsed: DataFrame, vectors: DataFrame, source: str, dims: int, keys: Sequence[str] = ("session",)
) -> DataFrame:
    """Plain and recency-weighted mean vectors per key, as columns emb_000.. and recent_emb_000..

    The recent mean divides by the recent count, clipped at 1e-9.
    """
    keys = list(keys)
    return _mean_arrays(parsed, vectors, source, dims, keys).select(*keys, *_named("means", _mean_names(dims)))


def session_vectors(parsed: DataFrame, vectors: DataFrame, source: str, dims: int) -> DataFrame:
    """`session_emb_*` means and `recent_emb_*` recency-weighted means."""
    out = mean_and_recent(parsed, vectors, source, dims)
    return out.withColumnsRenamed({f"emb_{i:03d}": f"session_emb_{i:03d}" for i in range(dims)})


def company_weighted_vectors(
    parsed: DataFrame, scored: DataFrame, vectors: DataFrame, source: str, dims: int
) -> DataFrame:
    """`weighted_emb_*`, `weighted_recent_emb_*`: relevance-weighted sums of company mean vectors."""
    means = _mean_arrays(parsed, vectors, source, dims, ["session", "company"])
    joined = scored.select("session", "company", "relevance_weight").join(means, ["session", "company"], "left")
    zero = F.array_repeat(F.lit(0.0), 2 * dims)
    weighted = joined.select("session", _scaled(F.coalesce("means", zero), F.col("relevance_weight")).alias("both"))
    sums = weighted.groupBy("session").agg(_array_sum(F.col("both")).alias("both"))
    return sums.select("session", *_named("both", [f"weighted_{n}" for n in _mean_names(dims)]))
