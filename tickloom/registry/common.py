"""Registration of queries with their independent SQL, and shared table fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom.session import materialize
from tickloom.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType)


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame callable, with equivalent SQL where there is any."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (without negative zero), integers as long."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(field.dataType, _INTEGRAL):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def tidy_sql(body: str, columns: str, source: str, digits: int = 6) -> str:
    """`body` holds WITH items; columns are 'name' (double), 'name:i' (bigint) or 'name:s' (text)."""
    out = []
    for item in columns.split():
        name, _, kind = item.partition(":")
        if kind == "i":
            out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif kind == "s":
            out.append(f'CAST("{name}" AS VARCHAR) AS "{name}"')
        else:
            out.append(f'round(CAST("{name}" AS DOUBLE), {digits}) + 0.0 AS "{name}"')
    return f"WITH {body}\nSELECT {', '.join(out)} FROM {source}"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "lineitem")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.bars_from_lineitem(lineitem(spark, sf_dir))


def written_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written once, for queries that read them more than once: the ticks are scanned and sorted a single time."""
    return materialize(bars(spark, sf_dir), "bars")


def placed_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks in session order, written once for queries that need both bars and headlines."""
    return materialize(adapters.ticks(lineitem(spark, sf_dir)), "ticks")


def seen_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.seen(bars(spark, sf_dir))


def unseen_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.unseen(bars(spark, sf_dir))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.headlines_from_lineitem(lineitem(spark, sf_dir))


# --- SQL fragments (WITH items) -------------------------------------------------------------

TICKS = """
ticks AS (
  SELECT l_suppkey AS session, l_extendedprice AS px, l_partkey, l_orderkey,
         row_number() OVER w AS pos, ntile(100) OVER w - 1 AS bar_ix
  FROM lineitem
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
                                             l_extendedprice, l_quantity, l_discount, l_tax))"""

BARS = (
    TICKS
    + """,
bars AS (
  SELECT session, bar_ix, arg_min(px, pos) AS open, max(px) AS high, min(px) AS low, arg_max(px, pos) AS close
  FROM ticks GROUP BY session, bar_ix),
seen AS (SELECT * FROM bars WHERE bar_ix < 50),
unseen AS (SELECT * FROM bars WHERE bar_ix >= 50)"""
)

TARGETS = (
    BARS
    + """,
halfway AS (SELECT session, arg_max(close, bar_ix) AS close_halfway FROM seen WHERE close IS NOT NULL GROUP BY session),
finish AS (SELECT session, arg_max(close, bar_ix) AS close_end FROM unseen WHERE close IS NOT NULL GROUP BY session),
targets AS (
  SELECT session, close_halfway, close_end, close_end / close_halfway - 1 AS target_return
  FROM halfway JOIN finish USING (session))"""
)

_HEADLINE_ROWS = """
headlines AS (
  SELECT session, bar_ix, pos,
    CASE l_partkey % 4 WHEN 0 THEN 'Relbos' WHEN 1 THEN 'Alvis Corp'
                       WHEN 2 THEN 'Yorvof Systems' ELSE 'Tandem Peak Labs' END || ' ' ||
    CASE (l_partkey + l_orderkey) % 9
      WHEN 0 THEN 'reports record quarterly revenue of $' || CAST(l_partkey % 90 + 1 AS VARCHAR) || '.5M'
      WHEN 1 THEN 'misses quarterly revenue estimates by ' || CAST(l_partkey % 40 + 1 AS VARCHAR) || '%'
      WHEN 2 THEN 'secures $2B contract with a global retailer'
      WHEN 3 THEN 'withdraws from Southeast Asia'
      WHEN 4 THEN 'chief operating officer steps down unexpectedly'
      WHEN 5 THEN 'sees mixed results in cloud infrastructure'
      WHEN 6 THEN 'wins industry award'
      WHEN 7 THEN 'delays product launch in Europe'
      ELSE 'holds quiet period' END AS headline
  FROM ticks WHERE bar_ix < 50)"""

HEADLINES = TICKS + "," + _HEADLINE_ROWS
BARS_HEADLINES = BARS + "," + _HEADLINE_ROWS
TARGETS_HEADLINES = TARGETS + "," + _HEADLINE_ROWS
