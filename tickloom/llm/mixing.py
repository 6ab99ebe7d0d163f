"""Mixing of sources to target weights: hash-random order, distributed prefix sums of word counts, exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.common import query, table
from tickloom.llm.prefix import hash_key, sums_before
from tickloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], factor: float, epochs: int) -> DataFrame:
    """(source_key, source_size, target) from one row per source (source_key sorted as the sources are, source_size).

    Sources take `weights` in turn by source order and share factor * total; no target exceeds epochs * source_size. What a full
    source cannot take is shared again by weight. That ends where every target is least(level * weight, epochs * size)
    for one level, which is found from running sums over sources in the order in which they fill. One row per source goes
    through one window; the number of sources is that of data feeds, not of documents.
    """
    everywhere = Window.partitionBy(F.lit(0))
    nth = F.row_number().over(everywhere.orderBy("source_key")) - 1
    turns = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * epochs).cast("double")
    rows = sizes.withColumn("weight", turns).withColumn("cap", cap)
    filled = everywhere.orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(factor)) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    open_weight = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    rows = rows.withColumn("level", left / open_weight)
    rows = rows.withColumn("first_open", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everywhere))
    level = F.coalesce(F.col("first_open"), F.lit(float("inf")))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(level * F.col("weight"), F.col("cap")))
    return rows.select("source_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), factor: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """(doc_id, source, tag, size, source_size, target, before, taken) for every row of `docs` (doc_id, text, source).

    Documents of a source are ordered by a hash of seed and id. A budget (the rounded target) takes every document whole as
    often as the source's size goes into it; the remainder is cut off the order at its exact word, so one document of a source at
    most is taken in part (its first words). taken counts words, repeats included; it never exceeds epochs * size.
    Null texts have size 0; null sources are one source, sorted last; null ids are hashed as empty. Rows with one id lie side
    by side and are ordered by text (`tag`); equal rows get the same place only in value, each is counted. Other columns are ignored. An
    empty table gives an empty one.
    """
    source_key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    rows = docs.select("doc_id", "source", source_key.alias("source_key"), F.xxhash64("text").alias("tag"), word_count().alias("size"))
    rows = rows.withColumn("key", hash_key(F.lit(seed), F.col("doc_id").cast("string")))
    rows = materialize(rows, "sizes")
    sources = materialize(targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, factor, epochs), "targets")
    placed = sums_before(rows, ["source_key"], "key", ["doc_id", "tag"], "size", "before", rows.count())
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before")))
    out = placed.join(sources, "source_key")  # a written table: broadcast where Spark sees that it is small
    return out.withColumn("copies", whole).withColumn("part", part.cast("long")).withColumn("taken", F.col("copies") * F.col("size") + F.col("part")).drop("key", "source_key")


def draw(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixture itself: rows of `docs`, repeated as `mixed` says; the partial copy keeps its first words.

    A row takes what was given to its id, text and source, so every source's drawn words are those it was given, in whatever order the rows
    come; rows equal in all three may change places. Nulls are matched with nulls. Documents without words are not part of a mixture of
    words and are left out. A cut text has its words joined by one space, and its own n_chars where there is such a column. Empty tables give an
    empty one.
    """
    # equal rows have one size; their parts may differ, so they are dealt out one by one
    names = {"doc_id": "__id", "tag": "__tag", "source": "__source", "copies": "__copies", "part": "__part"}
    want = mixed.select(*[F.col(c).alias(n) for c, n in names.items()])
    equal = Window.partitionBy("__id", "__tag", "__source").orderBy(F.desc("__part"))
    want = want.withColumn("__nth", F.row_number().over(equal)).where("__copies > 0 OR __part > 0")
    have = docs.withColumn("__own", F.xxhash64("text"))
    have = have.withColumn("__number", F.row_number().over(Window.partitionBy("doc_id", "__own", "source").orderBy(F.lit(0))))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
    same = same & (F.col("__own") == F.col("__tag")) & (F.col("__number") == F.col("__nth"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    whole = F.array_repeat(F.lit(-1).cast("long"), F.col("__copies").cast("int"))
    takes = F.when(F.col("__part") > 0, F.concat(whole, F.array("__part"))).otherwise(whole)
    rows = have.join(want, same).withColumn("__take", F.explode(takes))
    full = (F.col("__take") < 0) | (F.col("__take") == F.size(words))
    text = F.when(full, F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("__take").cast("int")), " "))
    rows = rows.withColumn("__full", full).withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__full"), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             substr(md5('mix:' || doc_id::VARCHAR), 1, 15) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
      FROM d GROUP BY source),
c AS (SELECT *, (2 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM c)::DOUBLE - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(weight) FROM c) - coalesce(sum(weight) OVER o, 0)) AS level
      FROM c WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0::DOUBLE ELSE least((SELECT max(level) FROM l WHERE level * weight <= cap) * weight, cap) END AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(size, greatest(0, budget - (budget // source_size) * source_size - before)) END)::BIGINT AS taken
FROM p
"""


@query("op8_mixing", ORACLE)
def op8_mixing(spark, sf_dir):
    """All documents mixed to 150 per cent of their words at weights 3, 1, 2, at most two epochs."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
