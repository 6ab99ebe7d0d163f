"""From raw documents to shards: language, near copies, benchmark passages, mixture, shards.

Each stage takes the documents that its predecessor kept, with all their columns, and returns documents with the same columns;
the last adds where each goes. The results of a stage are written and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickloom.llm import decontaminate, language_id, mixing, ngram_join, sharding
from tickloom.session import materialize

LEAST_SCORE = 0.3  # of the likeliest language


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learned from the labelled documents: texts without letters and those of no clear language go."""
    tagger, names = language_id.learn(docs)
    found = language_id.identify(docs, tagger, names)
    rejected = found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)).select("doc_id", "tag").distinct()
    return _without(docs, rejected)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component the document with the smallest id stays.

    Equal rows are one document. Texts without words and rows without an id are in no group and stay.
    """
    groups = ngram_join.similarity_components(docs)
    copies = groups.where("n_shingles > 0 AND doc_id <> component_id").select("doc_id", F.col("tag").alias("__tag")).distinct()
    kept = docs.withColumn("__tag", F.xxhash64("text")).join(copies, ["doc_id", "__tag"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", "__tag").orderBy(F.lit(0)))
    single = F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.withColumn("__n", nth).where(single | (F.col("__n") == 1)).select(*docs.columns)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a ten-word window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 3, 1, 2 at 150 per cent of all words: documents repeat, are cut at a budget's last word, or go."""
    return mixing.draw(docs, mixing.mix(docs))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """24 shards of even row counts, equal texts together: the documents with size, shard and slot."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_text),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign_shards),
]

ORACLE_SQL = None  # the first stage is a learned model; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`docs` without the rows that have the (doc_id, tag) of `rows`; tag is the hash of the text."""
    gone = rows.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__tag")), "left_anti")
