"""Session builder and materialisation through the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(app: str = "tickloom", cpus: str | int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PRIVATE: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; where it names none, a private one of a local session, deleted at exit."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"Set {CHECKPOINT_DIR} to a folder that every executor can reach.")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        _PRIVATE[app] = tempfile.mkdtemp(prefix="tickloom-")
        atexit.register(shutil.rmtree, _PRIVATE[app], ignore_errors=True)
    return _PRIVATE[app]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and leaves a columnar table that later scans can prune.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_scan(df: DataFrame) -> DataFrame:
    """A scan of few file splits spread over all cores before costly row work.

    Large inputs already have more splits than cores and pass unchanged, so nothing is shuffled there. Only for
    scans: the partition count of a plan with exchanges is not known before it runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


TASK_ROWS = 500_000  # rows that a task aggregates, where a scan of a compressed table would give it many times as many


def dealt(table: DataFrame, order: Sequence[str]) -> DataFrame:
    """A written table in tasks of a bounded number of rows, neighbours in `order` together.

    Splits of a scan are bounded in compressed bytes, which may be any number of rows. Counting a written table reads its footers only.
    """
    parts = -(-table.count() // TASK_ROWS)
    return table.repartitionByRange(parts, *order) if parts > table.rdd.getNumPartitions() else table
