"""Session alignment, column alignment and block concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.functions.numeric import fill_by_type


def restrict(frame: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of the given sessions (semi-join)."""
    return frame.join(sessions.select("session").distinct(), "session", "left_semi")


def align_sessions(features: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per distinct session, nulls filled by type."""
    return fill_by_type(sessions.select("session").distinct().join(features, "session", "left"))


def align_columns(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly `columns` after the session: missing ones 0, extra ones dropped, nulls 0."""
    present = set(frame.columns)
    return frame.select(
        "session",
        *[
            F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) if c in present else F.lit(0.0).alias(c)
            for c in columns
        ],
    )


def pick_columns(frame: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The listed columns that exist, in the listed order; all of them for None."""
    if columns is None:
        return frame
    return frame.select("session", *[c for c in columns if c in frame.columns])


def prefix_columns(frame: DataFrame, alias: str) -> DataFrame:
    return frame.withColumnsRenamed({c: f"{alias}__{c}" for c in frame.columns if c != "session"})


def to_numeric(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as double; what does not parse counts as 0."""
    return frame.withColumns(
        {c: F.coalesce(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(0.0)) for c in columns}
    )


def split_by_type(frame: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the text and the other columns, the session aside."""
    text = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType)]
    return text, [c for c in frame.columns if c not in text and c != "session"]


def concat_blocks(sessions: DataFrame, blocks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Blocks side by side on the session spine, columns named alias__column, nulls 0."""
    out = sessions.select("session").distinct()
    for alias, block in blocks:
        out = out.join(prefix_columns(block, alias), "session", "left")
    return out.na.fill(0.0)


def standardise(frame: DataFrame, columns: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """Z-scores by population mean and std; a std at or below the floor counts as 1."""
    stats = frame.agg(
        *[F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"__s{i}") for i, c in enumerate(columns)],
    )
    rows = frame.crossJoin(F.broadcast(stats))

    def z(i: int, c: str):
        scale = F.when(F.col(f"__s{i}") > floor, F.col(f"__s{i}")).otherwise(F.lit(1.0))
        return ((F.col(c) - F.col(f"__m{i}")) / scale).alias(c)

    kept = [c for c in frame.columns if c not in columns]
    return rows.select(*kept, *[z(i, c) for i, c in enumerate(columns)])
