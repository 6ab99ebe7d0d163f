"""Registry of this subpackage's queries, and its table reader."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """`df` as a written table in the shared folder, bucketed by `column`: later joins on it do not move its rows."""
    spark = df.sparkSession
    full = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).format("parquet").option("path", f"{checkpoint_dir(spark).rstrip('/')}/{full}").saveAsTable(full)
    return spark.table(full)
