"""Session folds, repeated folds and hold-out splits from a hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.ranking import ntile_of, ranked


def hash_order(session: Column, seed: Column) -> Column:
    return F.md5(F.concat(session.cast("string"), F.lit(":"), seed.cast("string")))


def session_folds(sessions: DataFrame, n_folds: int = 5, seed: int = 42, n_repeats: int = 1) -> DataFrame:
    """(session, repeat, seed, fold): every session in one fold per repeat, sizes differing by at most one.

    Sessions are ordered by md5(session:seed) and cut into equal runs. The order runs through range
    partitions, so a billion sessions are never sorted in one task.
    """
    if n_folds < 2:
        raise ValueError("At least two folds are needed.")
    if n_repeats < 1:
        raise ValueError("At least one repeat is needed.")
    base = sessions.select("session").where(F.col("session").isNotNull()).distinct()
    rows = base.select("session", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("repeat"))
    rows = rows.withColumn("seed", F.lit(seed) + F.col("repeat"))
    rows = rows.withColumn("__h", hash_order(F.col("session"), F.col("seed")))
    placed = ranked(rows, ["repeat"], ["__h", "session"], rank="__rn", size="__n")
    too_few = F.raise_error(F.lit("More folds than sessions.")).cast("int")
    fold = F.when(F.col("__n") < n_folds, too_few).otherwise(ntile_of(F.col("__rn"), F.col("__n"), n_folds) - 1)
    return placed.select("session", "repeat", "seed", fold.alias("fold"))


def holdout_split(sessions: DataFrame, seed: int = 42, parts: int = 5) -> DataFrame:
    """(session, is_valid): one part in `parts` held out."""
    folds = session_folds(sessions, parts, seed)
    return folds.select("session", (F.col("fold") == 0).alias("is_valid"))
