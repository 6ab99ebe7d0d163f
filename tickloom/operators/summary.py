"""Session text summary: additive sums, relevance summary, top-company slots, weighted sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.numeric import ratio

# Output column names.
ADDITIVE_COLUMNS = [
    "headline_count",
    "recent_headline_count",
    "very_recent_headline_count",
    "early_half_headline_count",
    "late_half_headline_count",
    "positive_count",
    "negative_count",
    "neutral_count",
    "late_positive_count",
    "late_negative_count",
    "late_neutral_count",
    "strong_event_count",
    "late_strong_event_count",
    "polarity_sum",
    "polarity_abs_sum",
    "amount_sum_m",
    "amount_max_m",
    "pct_sum",
    "pct_abs_sum",
    "pct_abs_max",
    "pct_signed_sum",
    "has_amount_count",
    "has_pct_count",
]

# Output column names.
SUMMARY_COLUMNS = [
    "n_companies",
    "headline_bar_coverage_sum",
    "headline_density_mean",
    "top_company_share",
    "top_recent_share",
    "top1_relevance",
    "top1_weight",
    "top2_relevance",
    "top2_weight",
    "company_entropy",
    "relevance_entropy",
    "company_concentration",
    "relevance_concentration",
    "conflict_score_mean",
    "conflict_score_max",
    "weighted_conflict_score",
    "weighted_polarity_disagreement",
    "positive_company_margin",
    "negative_company_margin",
    "strong_event_company_margin",
    "relevance_instability",
    "top_company_switch_flag",
    "relevance_gap",
    "weight_gap",
    "company_entropy_norm",
    "relevance_entropy_norm",
]

# Output column names.
SLOT_COLUMNS = [
    "headline_count",
    "recent_headline_count",
    "very_recent_headline_count",
    "early_half_headline_count",
    "late_half_headline_count",
    "bar_coverage",
    "last_bar_ix",
    "mean_bar_ix",
    "positive_count",
    "negative_count",
    "neutral_count",
    "late_positive_count",
    "late_negative_count",
    "late_neutral_count",
    "strong_event_count",
    "late_strong_event_count",
    "polarity_sum",
    "polarity_abs_sum",
    "conflict_score",
    "polarity_flip_count",
    "polarity_flip_rate",
    "time_since_last_strong_event",
    "headline_gap_mean",
    "headline_gap_cv",
    "headline_burstiness",
    "max_headlines_single_bar",
    "amount_sum_m",
    "amount_max_m",
    "pct_sum",
    "pct_abs_sum",
    "pct_abs_max",
    "pct_signed_sum",
    "mention_share",
    "recent_share",
    "early_share",
    "late_share",
    "bar_coverage_share",
    "last_bar_ix_norm",
    "relevance_score",
    "relevance_weight",
]

TOP_K = 2


def top_companies(scored: DataFrame, k: int) -> DataFrame:
    """The k most relevant companies per session with their slot 1..k.

    Ties by headline count, then company. Spark limits each map task to k rows per session before the
    shuffle (window group limit), so a session of very many companies stays cheap.
    """
    order = [F.round("relevance_score", 12).desc(), F.col("headline_count").desc(), F.col("company")]
    slot = F.row_number().over(Window.partitionBy("session").orderBy(*order))
    return scored.withColumn("slot", slot).where(F.col("slot") <= k)


def company_slots(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """`top{slot}_*` columns, one row per session."""
    top = top_companies(scored, k)
    spread = [
        F.max(F.when(F.col("slot") == s, F.col(c))).alias(f"top{s}_{c}") for s in range(1, k + 1) for c in SLOT_COLUMNS
    ]
    return top.groupBy("session").agg(*spread)


def _entropy(p: Column) -> Column:
    return F.coalesce(-F.sum(F.when(p > 0, p * F.log(p))), F.lit(0.0))


def _margins(scored: DataFrame) -> DataFrame:
    """Largest minus second-largest share of the session's positive, negative and strong counts."""
    metrics = {
        "positive_company_margin": "positive_count",
        "negative_company_margin": "negative_count",
        "strong_event_company_margin": "strong_event_count",
    }
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("x")) for m, c in metrics.items()])
    long = scored.select("session", "company", F.explode(items).alias("i")).select("session", "company", "i.*")
    place = F.row_number().over(Window.partitionBy("session", "metric").orderBy(F.col("x").desc(), "company"))
    top = long.withColumn("place", place).where(F.col("place") <= 2)
    sign = F.when(F.col("place") == 1, F.col("x")).otherwise(-F.col("x"))
    return top.groupBy("session").agg(
        *[F.sum(F.when(F.col("metric") == m, sign)).alias(f"__{m}") for m in metrics]
    )


def relevance_summary(scored: DataFrame) -> DataFrame:
    """Additive sums and the twenty-six summary columns, one row per session."""
    w, share = F.col("relevance_weight"), F.col("mention_share")
    active = (F.col("positive_count") + F.col("negative_count")) > 0
    early, late = F.col("early_share"), F.col("late_share")

    def first_by(x: Column) -> Column:
        return F.min_by("company", F.struct((-x).alias("x"), F.col("company").alias("company")))

    agg = scored.groupBy("session").agg(
        *[F.sum(c).alias(c) for c in ADDITIVE_COLUMNS],
        F.count(F.lit(1)).cast("double").alias("n_companies"),
        F.sum("bar_coverage").alias("headline_bar_coverage_sum"),
        F.avg("headline_density").alias("headline_density_mean"),
        F.max("mention_share").alias("top_company_share"),
        F.max("recent_share").alias("top_recent_share"),
        F.max("relevance_score").alias("top1_relevance"),
        F.max("relevance_weight").alias("top1_weight"),
        _entropy(share).alias("company_entropy"),
        _entropy(w).alias("relevance_entropy"),
        F.sum(share * share).alias("company_concentration"),
        F.sum(w * w).alias("relevance_concentration"),
        F.avg("conflict_score").alias("conflict_score_mean"),
        F.max("conflict_score").alias("conflict_score_max"),
        F.sum(w * F.col("conflict_score")).alias("weighted_conflict_score"),
        F.sum(F.when(active, w * F.signum("polarity_sum"))).alias("__direction"),
        F.sum(F.when(active, w)).alias("__active_weight"),
        (F.sum(F.abs(early - late)) * 0.5).alias("relevance_instability"),
        first_by(early).alias("__early_top"),
        first_by(late).alias("__late_top"),
    )
    second = (
        top_companies(scored, 2)
        .where(F.col("slot") == 2)
        .select(
            "session",
            F.col("relevance_score").alias("top2_relevance"),
            F.col("relevance_weight").alias("top2_weight"),
        )
    )
    zero = F.lit(0.0)
    joined = (
        agg.join(second, "session", "left")
        .join(_margins(scored), "session", "left")
        .na.fill(0.0, ["top2_relevance", "top2_weight"])
    )
    both_halves = (F.col("early_half_headline_count") > 0) & (F.col("late_half_headline_count") > 0)
    log_n = F.log(F.greatest(F.col("n_companies"), F.lit(1.0)))
    scale = F.when(log_n == 0, F.lit(1.0)).otherwise(log_n)

    def margin(metric: str, total: str) -> Column:
        return F.when(F.col(total) > 0, ratio(F.col(f"__{metric}"), F.col(total))).otherwise(zero)

    return joined.withColumns(
        {
            "weighted_polarity_disagreement": F.when(
                F.col("__active_weight") > 0, 1.0 - ratio(F.abs("__direction"), F.col("__active_weight"))
            ).otherwise(zero),
            "positive_company_margin": margin("positive_company_margin", "positive_count"),
            "negative_company_margin": margin("negative_company_margin", "negative_count"),
            "strong_event_company_margin": margin("strong_event_company_margin", "strong_event_count"),
            "top_company_switch_flag": F.when(
                both_halves & (F.col("__early_top") != F.col("__late_top")), F.lit(1.0)
            ).otherwise(zero),
            "relevance_gap": F.col("top1_relevance") - F.col("top2_relevance"),
            "weight_gap": F.col("top1_weight") - F.col("top2_weight"),
            "company_entropy_norm": F.col("company_entropy") / scale,
            "relevance_entropy_norm": F.col("relevance_entropy") / scale,
        }
    ).select("session", *ADDITIVE_COLUMNS, *SUMMARY_COLUMNS)


def weighted_sums(scored: DataFrame) -> DataFrame:
    """`w_*`: relevance-weighted sums of the slot columns, one row per session."""
    w = F.col("relevance_weight")
    return scored.groupBy("session").agg(*[F.sum(w * F.col(c)).alias(f"w_{c}") for c in SLOT_COLUMNS])


def weighted_category_sums(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """Long `w_<category>` sums (session, feature, value) of company category counts."""
    weights = scored.select("session", "company", "relevance_weight")
    return (
        counts.join(weights, ["session", "company"])
        .groupBy("session", F.concat(F.lit("w_"), F.col("column")).alias("feature"))
        .agg(F.sum(F.col("value") * F.col("relevance_weight")).alias("value"))
    )


def spread_categories(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pivot long category sums against an explicit column list."""
    cells = [F.sum(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features]
    if not cells:
        return long.select("session").distinct()
    return long.groupBy("session").agg(*cells).na.fill(0.0)


def session_text_features(
    scored: DataFrame, counts: DataFrame | None = None, k: int = TOP_K, categories: Sequence[str] = ()
) -> DataFrame:
    """Sums, summary, slots and weighted sums side by side; `categories` are `w_<column>` names to add."""
    out = (
        relevance_summary(scored)
        .join(company_slots(scored, k), "session", "left")
        .join(weighted_sums(scored), "session", "left")
    )
    if counts is not None and categories:
        out = out.join(spread_categories(weighted_category_sums(scored, counts), categories), "session", "left")
    return out.na.fill(0.0)


