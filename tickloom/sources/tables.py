"""Scans of bar, headline and prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom.sources.schemas import BARS, HEADLINES, PREDICTIONS, REGISTRY

SPLITS = ("train", "public_test", "private_test")
VISIBILITIES = ("seen", "unseen")


def dataset_path(root: str, kind: str, visibility: str, split: str) -> str:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}.")
    if visibility not in VISIBILITIES:
        raise ValueError(f"visibility must be one of {VISIBILITIES}, not {visibility!r}.")
    if visibility == "unseen" and split != "train":
        raise ValueError(f"The {split} split has no unseen part.")
    return f"{root.rstrip('/')}/{kind}_{visibility}_{split}.parquet"


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def load_bars(spark: SparkSession, root: str, split: str, visibility: str = "seen") -> DataFrame:
    return _scan(spark, dataset_path(root, "bars", visibility, split), BARS)


def load_headlines(spark: SparkSession, root: str, split: str, visibility: str = "seen") -> DataFrame:
    return _scan(spark, dataset_path(root, "headlines", visibility, split), HEADLINES)


def load_train_bars(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return load_bars(spark, root, "train"), load_bars(spark, root, "train", "unseen")


def load_train_headlines(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return load_headlines(spark, root, "train"), load_headlines(spark, root, "train", "unseen")


def _layout() -> list[tuple[str, str]]:
    return [(v, s) for v in VISIBILITIES for s in SPLITS if v == "seen" or s == "train"]


def load_all(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All bars or headlines under `root` with their visibility and split as columns.

    Both are constants of their file, so a filter on them leaves only the files it asks for in the plan.
    """
    schema = {"bars": BARS, "headlines": HEADLINES}[kind]
    out = None
    for visibility, split in _layout():
        part = _scan(spark, dataset_path(root, kind, visibility, split), schema)
        part = part.select(F.lit(visibility).alias("visibility"), F.lit(split).alias("split"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def save_split(df: DataFrame, root: str, kind: str, visibility: str, split: str) -> str:
    """Write bars or headlines where the loaders look for them, with exactly their columns."""
    schema = {"bars": BARS, "headlines": HEADLINES}[kind]
    path = dataset_path(root, kind, visibility, split)
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode("overwrite").parquet(path)
    return path


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The JSON lines of a prediction registry as columns; keys that a line lacks are null, further keys stay in `record`."""
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", REGISTRY).alias("r"), F.col("value").alias("record")).select("r.*", "record")


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).csv(path, header=True)


def expected_sessions(spark: SparkSession, root: str, *splits: str) -> DataFrame:
    """Distinct sessions of the given splits' seen bars (a one-column scan)."""
    parts = [load_bars(spark, root, split).select("session") for split in splits]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.distinct()
