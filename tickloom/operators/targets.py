"""First and last prices, targets, pnl and Sharpe ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.numeric import double, moments_corr, ratio
from tickloom.functions.ranking import BUCKET, range_parts

ANNUALIZATION = 16.0


def last_close(name: str = "close") -> Column:
    """Last non-null close in bar order, as an aggregate."""
    present = F.col("close").isNotNull()
    return F.max_by(F.when(present, F.col("close")), F.when(present, F.col("bar_ix"))).alias(name)


def first_price(column: str, name: str | None = None) -> Column:
    """First non-null value in bar order, as an aggregate."""
    present = F.col(column).isNotNull()
    return F.min_by(F.when(present, F.col(column)), F.when(present, F.col("bar_ix"))).alias(name or column)


def build_targets(seen: DataFrame, unseen: DataFrame) -> DataFrame:
    """`close_halfway`, `close_end`, `target_return` of sessions present on both sides."""
    halfway = seen.groupBy("session").agg(last_close("close_halfway"))
    end = unseen.groupBy("session").agg(last_close("close_end"))
    return halfway.join(end, "session").withColumn(
        "target_return", ratio(double("close_end"), double("close_halfway")) - 1.0
    )


def pnl(position: Column, realized: Column) -> Column:
    return double(position) * double(realized)


def sharpe(value: Column, annualization: float = ANNUALIZATION) -> Column:
    """mean/population std times the factor, 0 where the std is 0 (an aggregate)."""
    std = F.stddev_pop(value)
    return F.when(std > 0, ratio(F.avg(value), std) * annualization).otherwise(F.lit(0.0))


def sharpe_epsilon(value: Column, annualization: float = ANNUALIZATION) -> Column:
    """The older form: mean/(std + 1e-9) times the factor, unguarded."""
    return F.avg(value) / (F.stddev_pop(value) + F.lit(1e-9)) * annualization


def sharpe_by(df: DataFrame, keys: Sequence[str], position: str, realized: str) -> DataFrame:
    value = pnl(F.col(position), F.col(realized))
    return df.groupBy(*keys).agg(sharpe(value).alias("sharpe"))


def momentum(seen: DataFrame) -> DataFrame:
    """Return from the first to the last seen close."""
    ends = seen.groupBy("session").agg(first_price("close", "close_start"), last_close("close_halfway"))
    return ends.withColumn("momentum", ratio(F.col("close_halfway"), F.col("close_start")) - 1.0)


def momentum_positions(train_seen: DataFrame, train_unseen: DataFrame, test_seen: DataFrame) -> DataFrame:
    """position = sign(corr(momentum, target) on train) * momentum * 100 on the test sessions."""
    train = momentum(train_seen).join(
        build_targets(train_seen, train_unseen).select("session", "target_return"), "session", "left"
    )
    direction = train.agg(F.signum(moments_corr(F.col("momentum"), F.col("target_return"))).alias("direction"))
    # One row: the broadcast size is fixed.
    scored = momentum(test_seen).crossJoin(F.broadcast(direction))
    return scored.select("session", (F.col("momentum") * F.col("direction") * 100.0).alias("target_position"))


STRATEGIES = (
    "always_buy",
    "always_sell",
    "random_normal",
    "momentum",
    "mean_reversion",
    "momentum_sign",
    "perfect",
    "worst",
    "buy_losers",
    "buy_winners",
)


def strategy_positions(frame: DataFrame, seed: int = 42, random: bool = True) -> DataFrame:
    """Unpivot (session, seen_return, target_return) into one position row per static strategy.

    The random strategy draws a normal value from md5 bits of (session, seed), so it does not depend on the partitioning or
    the engine.
    """
    r, y = double("seen_return"), double("target_return")
    one = F.lit(1.0)

    def uniform(salt: int) -> Column:
        text = F.concat_ws(":", F.col("session").cast("string"), F.lit(str(seed)), F.lit(str(salt)))
        bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")
        return (bits + 1).cast("double") / F.lit(float((1 << 28) + 1))

    normal = F.sqrt(F.lit(-2.0) * F.log(uniform(1))) * F.cos(F.lit(2.0) * F.pi() * uniform(2))
    positions = {
        "always_buy": one,
        "always_sell": -one,
        "random_normal": normal,
        "momentum": r,
        "mean_reversion": -r,
        "momentum_sign": F.when(r == 0, one).otherwise(F.signum(r)),
        "perfect": y,
        "worst": -y,
        "buy_losers": F.when(r < 0, one).otherwise(F.lit(0.0)),
        "buy_winners": F.when(r > 0, one).otherwise(F.lit(0.0)),
    }
    if not random:
        positions.pop("random_normal")
    pairs = F.array(
        *[F.struct(F.lit(n).alias("strategy"), c.cast("double").alias("position")) for n, c in positions.items()]
    )
    return frame.select("session", y.alias("target_return"), F.explode(pairs).alias("s")).select(
        "session", "s.strategy", "s.position", "target_return"
    )


def strategy_sharpes(frame: DataFrame, seed: int = 42, random: bool = True) -> DataFrame:
    long = strategy_positions(frame, seed, random)
    value = F.col("position") * F.col("target_return")
    return long.groupBy("strategy").agg(sharpe_epsilon(value).alias("sharpe"))


def strategy_frame(seen: DataFrame, unseen: DataFrame) -> DataFrame:
    opening = seen.groupBy("session").agg(first_price("open"), last_close("close_halfway"))
    returns = opening.select("session", (ratio(F.col("close_halfway"), F.col("open")) - 1.0).alias("seen_return"))
    return returns.join(build_targets(seen, unseen).select("session", "target_return"), "session")


def cumulative_pnl(df: DataFrame, value: Column) -> DataFrame:
    """Running pnl in session order over the whole table.

    Range partitions of the session are summed, the few sums are prefix-summed, and the running sum is taken
    inside each partition only.
    """
    rows = range_parts(df.select("session", value.alias("pnl")), ["session"])
    totals = rows.groupBy(BUCKET, "__part").agg(F.sum("pnl").alias("__t"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__t").over(before), F.lit(0.0)).alias("__o"))
    inside = Window.partitionBy(BUCKET, "__part").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(offsets), "__part").select(
        "session", "pnl", (F.col("__o") + F.sum("pnl").over(inside)).alias("cumulative_pnl")
    )


def regression_metrics(df: DataFrame, prediction: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """R2 and MSE."""
    p, y = double(prediction), double(target)
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(
        F.when(sst > 0, F.lit(1.0) - ratio(sse, sst)).alias("r2"),
        (ratio(sse, F.count(y).cast("double"))).alias("mse"),
    )
