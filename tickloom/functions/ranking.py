"""Exact ranks and percentiles that never bring one whole group into one task."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickloom.session import checkpoint_dir, materialize

PART = "__part"
BUCKET = "__bucket"
PART_ROWS = 500_000  # rows of a range part at most, about: what a task sorts and numbers
SPARE_KEYS = 12  # keys tried for a bucket beyond the logarithm of their number; fewer than one set of buckets in 100,000 misses any then


@cache
def even_keys(spark: SparkSession, buckets: int) -> list[int]:
    """For each of `buckets` hash buckets an integer that falls into it, so that rows labelled with them fill the buckets evenly.

    Numbers counted up would not: some buckets get four of them and a third gets none. A bucket that no tried key hits shares another's.
    """
    tried = spark.range(0, int(buckets * (math.log(buckets) + SPARE_KEYS)), 1, 1).select(F.col("id").cast("int").alias("key"))
    hit = tried.select(F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket"), "key").collect()
    found = {r["bucket"]: r["key"] for r in reversed(hit)}
    return [found.get(b, b) for b in range(buckets)]


def range_parts(df: DataFrame, order: Sequence[Column | str], part: str = PART) -> DataFrame:
    """`df` written in range partitions of `order`, numbered by `part`: an even bucket for any distribution.

    The partition number never decreases along `order`. The table is written once, because two runs of a range partitioning may cut at
    different places, and bucketed by BUCKET, which `part` determines, so that a window inside a part and bucket needs no further
    exchange. Each bucket holds one part, so no task gets several. Parts grow in number with the rows, not in size.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    keys = F.array(*[F.lit(k) for k in even_keys(spark, parts)])
    ranged = df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id())
    ranged = ranged.withColumn(BUCKET, F.get(keys, F.col(part) % parts))
    name = f"ranged_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    ranged.write.bucketBy(parts, BUCKET).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], rank: str = "rn", size: str | None = None) -> DataFrame:
    """Row number (1-based) of every row inside its group under `order`, optionally with the group's size.

    Rows are range-partitioned by (group, order), so a group of any size is cut into even parts, and ranked inside their part. Only the
    first and the last group of a part can reach into another one: their rows are counted by part and prefix-summed. That
    is at most two rows a partition, which bounds the broadcast. `df` is read three times: to count it, to find the cuts, and to write it.
    """
    keys = list(group)
    table = range_parts(df, [*keys, *order])
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(True)
    groups = table.select(BUCKET, PART, *keys).distinct()  # hashed; ends of whole rows would sort each part
    ends = groups.groupBy(BUCKET, PART).agg(F.array(F.min(key), F.max(key)).alias("__ends"))
    wide = ends.select(F.explode("__ends").alias("__key"), PART).distinct().groupBy("__key").agg(F.count(F.lit(1)).alias("__parts"))
    wide = wide.where(F.col("__parts") > 1).select("__key")
    found = F.broadcast(wide.withColumnRenamed("__key", "__w"))
    held = table.select(key.alias("__key"), PART).join(found, F.col("__key").eqNullSafe(F.col("__w")), "left_semi")
    counts = held.groupBy("__key", PART).agg(F.count(F.lit(1)).alias("__c"))
    scope = Window.partitionBy("__key")
    before = F.coalesce(F.sum("__c").over(scope.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("__key").alias("__k"), F.col(PART).alias("__p"), before.alias("__offset"), F.sum("__c").over(scope).alias("__size"))
    placed = table.join(F.broadcast(offsets), (F.col(PART) == F.col("__p")) & key.eqNullSafe(F.col("__k")), "left")
    inside = Window.partitionBy(BUCKET, PART, *keys)
    out = {rank: F.coalesce(F.col("__offset"), F.lit(0)) + F.row_number().over(inside.orderBy(*order))}
    if size:
        out[size] = F.coalesce(F.col("__size"), F.count(F.lit(1)).over(inside))
    return placed.withColumns(out).drop("__offset", "__size", "__k", "__p", PART, BUCKET)


def ntile_of(rank: Column, size: Column, tiles: int) -> Column:
    """The ntile (1-based) of a 1-based rank in a group of `size` rows; larger tiles come first."""
    small = F.floor(size / F.lit(tiles)).cast("long")
    extra = size % F.lit(tiles)
    head = extra * (small + 1)
    in_head = F.floor((rank - 1) / (small + 1))
    in_tail = extra + F.floor((rank - 1 - head) / F.greatest(small, F.lit(1)))
    return (F.when(rank <= head, in_head).otherwise(in_tail) + 1).cast("int")


# Groups up to this many rows are ordered whole; in larger ones the candidates are narrowed down to about as many.
WHOLE_GROUP_ROWS = 100_000
SKETCH_ACCURACY = 10_000
LATER_CUTS = [i / 200 for i in range(201)]


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, out: str, few_groups: bool = False
) -> DataFrame:
    """Exact percentile with linear interpolation per group, nulls skipped.

    `few_groups` says that the caller knows the number of groups and that it is small (folds times trials).

    A bracket [lo, hi] of values holds the wanted ranks of each group. While a bracket holds more than WHOLE_GROUP_ROWS rows and more than
    one value, mergeable sketches of the rows inside cut it, the rows of every piece are counted exactly, and the pieces
    that hold the ranks become the bracket: first around the percentile, then into 200 pieces a round. What is left is
    grouped to distinct values before it is ordered, so neither ties nor large groups gather in a task.
    """
    keys = list(keys)
    by = keys or ["__one"]
    base = df.withColumn("__one", F.lit(0)).select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    n, at = F.count(F.lit(1)), (F.col("__n") - 1) * F.lit(float(q))
    brackets = base.groupBy(*by).agg(n.alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    brackets = brackets.withColumns({"__a": F.floor(at), "__b": F.ceil(at), "__below": F.lit(0).cast("long"), "__inside": F.col("__n")})
    brackets = materialize(brackets, "brackets")
    wide = (F.col("__inside") > WHOLE_GROUP_ROWS) & (F.col("__lo") < F.col("__hi"))
    margin = 3.0 / SKETCH_ACCURACY
    cuts, left = [max(0.0, q - margin), min(1.0, q + margin)], None
    while (rows := brackets.where(wide).agg(F.sum("__inside")).first()[0]) and rows != left:
        brackets = materialize(_narrowed(base, brackets, by, wide, cuts, few_groups), "brackets")
        cuts, left = LATER_CUTS, rows
    # One row per group. Broadcast for few groups: a shuffle on a handful of folds would gather the whole table in a handful of partitions.
    joined = base.join(F.broadcast(brackets) if few_groups else brackets, by).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
    counted = joined.groupBy(*by, "__n", "__a", "__b", "__below", "__v").agg(n.alias("__c"))
    order = Window.partitionBy(*by).orderBy("__v")
    cum = counted.withColumn("__cum", F.col("__below") + F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda rank: F.min(F.when(F.col("__cum") > F.col(rank), F.col("__v")))
    picked = cum.groupBy(*by, "__n").agg(first("__a").alias("__low"), first("__b").alias("__high"))
    return picked.select(*keys, (F.col("__low") + (F.col("__high") - F.col("__low")) * (at - F.floor(at))).alias(out))


def _narrowed(base: DataFrame, brackets: DataFrame, by: list[str], wide: Column, cuts: list[float], few_groups: bool) -> DataFrame:
    """`brackets` with the wide ones replaced by the pieces, between sketched cuts, that hold their ranks."""
    side = F.broadcast if few_groups else (lambda d: d)
    held = base.join(side(brackets.where(wide)), by).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
    sketched = held.groupBy(*by).agg(F.percentile_approx("__v", cuts, SKETCH_ACCURACY).alias("__cuts"))
    piece = F.size(F.filter("__cuts", lambda cut: cut < F.col("__v")))
    state = ["__n", "__a", "__b", "__below"]
    pieces = held.join(side(sketched), by).groupBy(*by, *state, piece.alias("__piece"))
    pieces = pieces.agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__c"))
    upto = F.col("__below") + F.sum("__c").over(Window.partitionBy(*by).orderBy("__piece"))
    pieces = pieces.withColumn("__upto", upto).where((F.col("__upto") > F.col("__a")) & (F.col("__upto") - F.col("__c") <= F.col("__b")))
    new = pieces.groupBy(*by, "__n", "__a", "__b").agg(
        F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.min(F.col("__upto") - F.col("__c")).alias("__below"), F.sum("__c").alias("__inside")
    )
    return brackets.where(~wide).unionByName(new)
