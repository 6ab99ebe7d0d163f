import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import ranking
from tickloom.functions.ranking import exact_percentile, ntile_of, ranked
from tickloom.operators.folds import holdout_split, session_folds


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    group = np.where(rng.random(3000) < 0.4, 7, rng.integers(0, 60, 3000))
    return pd.DataFrame({"g": group, "a": rng.integers(0, 40, 3000), "b": rng.permutation(3000)})


@pytest.mark.parametrize("parts", [3, 40])
def test_rank_equals_plain_sort_for_hot_and_cold_groups(spark, skewed, monkeypatch, parts):
    """Forty parts: the hot group lies in many of them, and most parts hold several groups."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for keys in (["g"], ["g", "s"]):
            rows = skewed.assign(s=np.where(skewed["a"] % 2 == 0, "even", None))
            df = spark.createDataFrame(rows).replace(float("nan"), None)
            got = ranked(df, keys, ["a", "b"], rank="rn", size="n").toPandas()
            want = rows.sort_values([*keys, "a", "b"])
            want["rn"] = want.groupby(keys, dropna=False).cumcount() + 1
            want["n"] = want.groupby(keys, dropna=False)["b"].transform("size")
            cols = ["g", "a", "b", "rn", "n"]
            assert (got[cols].sort_values("b").to_numpy() == want[cols].sort_values("b").to_numpy()).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rank_without_group(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = ranked(df, [], [F.col("b").desc()], rank="rn", size="n").toPandas()
    assert (got["rn"] == 3000 - got["b"]).all() and (got["n"] == 3000).all()
    assert ranked(df.limit(0), ["g"], ["b"]).count() == 0


def test_rank_moves_the_rows_once(spark, skewed):
    """After the range partitioning, the window works on the written parts: no exchange but those of small counts."""
    plan = ranked(spark.createDataFrame(skewed), ["g"], ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "Exchange hashpartitioning(__part" not in window.split("BroadcastExchange")[0]


@pytest.mark.parametrize("n,k", [(3, 5), (10, 4), (100, 100), (103, 5)])
def test_ntile(spark, n, k):
    df = spark.range(1, n + 1).withColumn("t", ntile_of(F.col("id"), F.lit(n), k)).orderBy("id").toPandas()
    want = [i + 1 for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    assert df["t"].tolist() == want


@pytest.mark.parametrize("whole, q", [(0, 0.0), (0, 0.1), (20, 0.5), (20, 0.9), (0, 1.0), (100_000, 0.1), (100_000, 0.5)])
def test_percentile_is_exact(spark, monkeypatch, whole, q):
    monkeypatch.setattr(ranking, "WHOLE_GROUP_ROWS", whole)
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=6000), np.zeros(3000), [np.pi]])
    pdf = pd.DataFrame({"k": [0] * 5000 + [1] * 4001, "v": values})
    got = exact_percentile(spark.createDataFrame(pdf), ["k"], "v", q, "p").toPandas().set_index("k")["p"]
    for k, part in pdf.groupby("k"):
        assert got[k] == pytest.approx(np.quantile(part["v"], q), abs=1e-12)


def test_percentile_skips_nulls_and_works_without_keys(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert exact_percentile(df, [], "v", 0.5, "p").head()["p"] == 2.0


def test_percentile_of_many_distinct_values(spark, monkeypatch):
    """Ten million distinct values in one group: the last step orders a bounded number of them."""
    counts = []
    narrowed = ranking._narrowed
    monkeypatch.setattr(ranking, "_narrowed", lambda *a: counts.append(1) or narrowed(*a))
    n = 10_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    assert exact_percentile(df, ["k"], "v", 0.25, "p", few_groups=True).head()["p"] == (n - 1) * 0.25
    assert len(counts) == 1


def test_folds_partition_the_sessions(spark):
    sessions = spark.range(103).withColumnRenamed("id", "session")
    folds = session_folds(sessions, 5, 42, 2).toPandas()
    sizes = folds.groupby(["repeat", "fold"]).size().unstack()
    assert (sizes.to_numpy() == [[21, 21, 21, 20, 20]] * 2).all()
    assert (folds.groupby("session").size() == 2).all()
    assert set(folds["seed"]) == {42, 43}
    assert holdout_split(sessions).where("is_valid").count() == 21


def test_fold_guards(spark):
    sessions = spark.range(3).withColumnRenamed("id", "session")
    with pytest.raises(ValueError):
        session_folds(sessions, 1)
    with pytest.raises(ValueError):
        session_folds(sessions, 2, n_repeats=0)
    with pytest.raises(Exception, match="More folds than sessions"):
        session_folds(sessions, 5).collect()


def test_parts_grow_in_number_with_the_rows(spark, skewed, monkeypatch):
    """Tasks that sort a bounded number of rows, whatever the input; the same ranks."""
    df = spark.createDataFrame(skewed)
    whole = ranked(df, ["g"], ["a", "b"], size="n").toPandas().sort_values("b")
    monkeypatch.setattr(ranking, "PART_ROWS", 50)
    sizes = ranking.range_parts(df, ["g", "a", "b"]).groupBy(ranking.PART).count().toPandas()["count"]
    assert len(sizes) > 40 and sizes.max() < 300
    again = ranked(df, ["g"], ["a", "b"], size="n").toPandas().sort_values("b")
    assert (whole[["g", "b", "rn", "n"]].to_numpy() == again[["g", "b", "rn", "n"]].to_numpy()).all()


def test_a_bucket_holds_one_part(spark, skewed, monkeypatch):
    """Part numbers hashed into buckets would put several parts into one task and none into others."""
    monkeypatch.setattr(ranking, "PART_ROWS", 50)
    written = ranking.range_parts(spark.createDataFrame(skewed), ["g", "a", "b"])
    parts = written.select(ranking.PART, F.pmod(F.hash(ranking.BUCKET), F.lit(60)).alias("file")).distinct().toPandas()
    assert len(parts) > 40 and parts.groupby("file")[ranking.PART].nunique().max() == 1
    for n in (1, 2, 48, 432):
        keys = spark.createDataFrame([(k,) for k in ranking.even_keys(spark, n)], "k int")
        assert keys.select(F.pmod(F.hash("k"), F.lit(n))).distinct().count() == n


def test_written_tables_are_dealt_in_bounded_tasks(spark, skewed, monkeypatch, tmp_path):
    from tickloom import session

    spark.createDataFrame(skewed).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert session.dealt(table, ["g", "b"]).rdd.getNumPartitions() == table.rdd.getNumPartitions()
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    sizes = session.dealt(table, ["g", "b"]).rdd.glom().map(len).collect()
    assert len(sizes) > 40 and max(sizes) < 300 and sum(sizes) == len(skewed)
