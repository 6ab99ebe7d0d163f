"""Bars, headlines and text vectors derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.ranking import ntile_of, ranked

BARS_PER_SESSION = 100
SEEN_BARS = 50

_TICK_ORDER = [
    "l_shipdate",
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks(lineitem: DataFrame) -> DataFrame:
    """Line items in session (supplier) order: rank `pos` and bar number `bar_ix` 0..99."""
    rows = lineitem.select("l_suppkey", *_TICK_ORDER).where(F.col("l_suppkey").isNotNull())
    placed = ranked(rows, ["l_suppkey"], _TICK_ORDER, rank="pos", size="n_ticks")
    bar = ntile_of(F.col("pos"), F.col("n_ticks"), BARS_PER_SESSION) - 1
    return placed.select(
        F.col("l_suppkey").alias("session"),
        bar.alias("bar_ix"),
        "pos",
        "l_partkey",
        "l_orderkey",
        F.col("l_extendedprice").alias("px"),
    )


def bars_from_ticks(placed: DataFrame) -> DataFrame:
    """OHLC bars; at most 100 rows per session whatever the tick count."""
    return placed.groupBy("session", "bar_ix").agg(
        F.min_by("px", "pos").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "pos").alias("close"),
    )


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return bars_from_ticks(ticks(lineitem))


def seen(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("bar_ix") < SEEN_BARS)


def unseen(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("bar_ix") >= SEEN_BARS)


def headlines_from_ticks(placed: DataFrame) -> DataFrame:
    """The seen ticks as headlines of four companies and nine bodies."""
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    names = F.array(*[F.lit(n) for n in ("Relbos", "Alvis Corp", "Yorvof Systems", "Tandem Peak Labs")])
    bodies = [
        F.concat(F.lit("reports record quarterly revenue of $"), part % 90 + 1, F.lit(".5M")),
        F.concat(F.lit("misses quarterly revenue estimates by "), part % 40 + 1, F.lit("%")),
        F.lit("secures $2B contract with a global retailer"),
        F.lit("withdraws from Southeast Asia"),
        F.lit("chief operating officer steps down unexpectedly"),
        F.lit("sees mixed results in cloud infrastructure"),
        F.lit("wins industry award"),
        F.lit("delays product launch in Europe"),
        F.lit("holds quiet period"),
    ]
    kind = (part + order) % len(bodies)
    body = F.element_at(F.array(*bodies), (kind + 1).cast("int"))
    company = F.element_at(names, (part % 4 + 1).cast("int"))
    return placed.where(F.col("bar_ix") < SEEN_BARS).select(
        "session", "bar_ix", "pos", F.concat_ws(" ", company, body).alias("headline")
    )


def headlines_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return headlines_from_ticks(ticks(lineitem))


def bars_from_events(events: DataFrame) -> DataFrame:
    """Bars of unequal session length: one bar per event of a user, opening at the previous value."""
    rows = events.where(F.col("user_id").isNotNull()).select("user_id", "ts", "event_id", "value")
    placed = ranked(rows, ["user_id"], ["ts", "event_id"], rank="pos")
    # The previous value comes by an equi-join on the position, not by a window over the whole user.
    previous = placed.select("user_id", (F.col("pos") + 1).alias("pos"), F.col("value").alias("prev"))
    joined = placed.join(previous, ["user_id", "pos"], "left").withColumn(
        "prev", F.coalesce("prev", "value")
    )
    return joined.select(
        F.col("user_id").alias("session"),
        (F.col("pos") - 1).cast("int").alias("bar_ix"),
        F.col("prev").alias("open"),
        F.greatest("prev", "value").alias("high"),
        F.least("prev", "value").alias("low"),
        F.col("value").alias("close"),
    )


def vector_id_of(text, n_vectors):
    """A stable vector number for a text: the first 28 bits of its md5, modulo the table size."""
    digest = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")
    return digest % n_vectors


def text_vectors(texts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Give every distinct non-empty text a vector of the `embeddings` table."""
    count = embeddings.agg(F.count(F.lit(1)).alias("n_vectors"))
    keyed = (
        texts.select("text")
        .where(F.col("text") != "")
        .distinct()
        .crossJoin(F.broadcast(count))
        .select("text", vector_id_of(F.col("text"), F.col("n_vectors")).alias("vec_id"))
    )
    return keyed.join(embeddings.select("vec_id", "embedding"), "vec_id").select("text", "embedding")
