"""Company-session aggregates, category counts and company relevance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.numeric import ratio
from tickloom.functions.ranking import ranked
from tickloom.operators.events import with_timing
from tickloom.operators.sequence import SEQUENCE_COLUMNS, sequence_features

# Output column names.
COMPANY_COLUMNS = [
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
RELEVANCE_COLUMNS = [
    "mention_share",
    "recent_share",
    "early_share",
    "late_share",
    "bar_coverage_share",
    "last_bar_ix_norm",
    "relevance_score",
    "relevance_weight",
    "relevance_rank",
]


def company_aggregates(cells: DataFrame) -> DataFrame:
    """The twenty-six aggregates per (session, company)."""
    n, pos, neg = F.col("n"), F.col("n_pos"), F.col("n_neg")
    neutral = n - pos - neg
    recent = F.col("is_recent")
    agg = with_timing(cells).groupBy("session", "company").agg(
        F.sum(n).alias("headline_count"),
        F.sum(n * recent).alias("recent_headline_count"),
        F.sum(n * F.col("is_very_recent")).alias("very_recent_headline_count"),
        F.sum(n * F.col("is_early_half")).alias("early_half_headline_count"),
        F.sum(n * F.col("is_late_half")).alias("late_half_headline_count"),
        # Cells are distinct in (session, company, bar), so the distinct bar count is a plain count.
        F.count("bar_ix").cast("double").alias("bar_coverage"),
        F.max("bar_ix").cast("double").alias("last_bar_ix"),
        ratio(F.sum(n * F.col("bar_ix")), F.sum(n)).alias("mean_bar_ix"),
        F.sum(pos).alias("positive_count"),
        F.sum(neg).alias("negative_count"),
        F.sum(neutral).alias("neutral_count"),
        F.sum(pos * recent).alias("late_positive_count"),
        F.sum(neg * recent).alias("late_negative_count"),
        F.sum(neutral * recent).alias("late_neutral_count"),
        F.sum("n_strong").alias("strong_event_count"),
        F.sum(F.col("n_strong") * recent).alias("late_strong_event_count"),
        F.sum(pos - neg).alias("polarity_sum"),
        F.sum(pos + neg).alias("polarity_abs_sum"),
        F.sum("amount_sum").alias("amount_sum_m"),
        F.max("amount_max").alias("amount_max_m"),
        F.sum("pct_sum").alias("pct_sum"),
        F.sum("pct_abs_sum").alias("pct_abs_sum"),
        F.max("pct_abs_max").alias("pct_abs_max"),
        F.sum("pct_signed_sum").alias("pct_signed_sum"),
        F.sum("n_amount").alias("has_amount_count"),
        F.sum("n_pct").alias("has_pct_count"),
    )
    return agg.select("session", "company", *COMPANY_COLUMNS)


def company_session(parsed: DataFrame, cells: DataFrame) -> DataFrame:
    """Aggregates, sequence statistics, conflict score and headline density per (session, company)."""
    joined = company_aggregates(cells).join(
        sequence_features(parsed, cells, ("session", "company")), ["session", "company"], "left"
    )
    pos, neg = F.col("positive_count"), F.col("negative_count")
    one = F.lit(1.0)
    return joined.withColumns(
        {
            "conflict_score": F.least(pos, neg) / F.greatest(pos + neg, one),
            "headline_density": F.col("headline_count") / F.greatest(F.col("bar_coverage"), one),
        }
    ).select("session", "company", *COMPANY_COLUMNS, *SEQUENCE_COLUMNS, "conflict_score", "headline_density")


def score_relevance(features: DataFrame, rank: bool = True) -> DataFrame:
    """Shares of the session's totals, the weighted relevance score, its softmax weight and its rank.

    Session totals come from two map-side-combined aggregates joined back, so a session with very many
    companies is not gathered in one task. The rank (ties by company) runs through range partitions.
    """
    one = F.lit(1.0)

    def floor1(c: Column) -> Column:
        return F.greatest(c, one)

    totals = features.groupBy("session").agg(
        F.sum("headline_count").alias("__n"),
        F.sum("recent_headline_count").alias("__recent"),
        F.sum("early_half_headline_count").alias("__early"),
        F.sum("late_half_headline_count").alias("__late"),
        F.sum("bar_coverage").alias("__bars"),
        F.max("last_bar_ix").alias("__last"),
    )
    shares = (
        features.join(totals, "session")
        .withColumns(
            {
                "mention_share": F.col("headline_count") / floor1(F.col("__n")),
                "recent_share": F.col("recent_headline_count") / floor1(F.col("__recent")),
                "early_share": F.col("early_half_headline_count") / floor1(F.col("__early")),
                "late_share": F.col("late_half_headline_count") / floor1(F.col("__late")),
                "bar_coverage_share": F.col("bar_coverage") / floor1(F.col("__bars")),
                "last_bar_ix_norm": F.col("last_bar_ix") / floor1(F.col("__last")),
            }
        )
        .withColumn(
            "relevance_score",
            F.col("mention_share") * 0.35
            + F.col("recent_share") * 0.30
            + F.col("bar_coverage_share") * 0.20
            + F.col("last_bar_ix_norm") * 0.15,
        )
        .drop(*[c for c in totals.columns if c.startswith("__")])
    )
    # Softmax is unchanged by a common shift; scores lie in [0, 1], so no shift is needed for range.
    norm = shares.groupBy("session").agg(F.sum(F.exp("relevance_score")).alias("__exp"))
    scored = (
        shares.join(norm, "session")
        .withColumn("relevance_weight", F.exp("relevance_score") / F.col("__exp"))
        .drop("__exp")
    )
    if not rank:
        return scored
    order = [F.round("relevance_score", 12).desc(), F.col("company")]
    placed = ranked(scored, ["session"], order, rank="relevance_rank")
    return placed.withColumn("relevance_rank", F.col("relevance_rank").cast("double"))


# Category blocks: (column, prefix, smallest total count, dropped values, dropped suffix); fixed values.
CATEGORY_RULES = [
    ("event_family", "event__", 25, (), "_other"),
    ("topic", "topic__", 1, ("none",), None),
    ("geography", "geo__", 1, ("none",), None),
    ("verb_family", "verb__", 10, ("unknown",), None),
    ("counterparty", "counterparty__", 20, ("none",), None),
]


def category_counts(parsed: DataFrame, keys: Sequence[str] = ("session", "company")) -> DataFrame:
    """Long counts (keys, column, value count) of all five categories, before any threshold.

    `min_total` carries the category's threshold. One pass: the five columns are unpivoted after a
    map-side count of their combinations.
    """
    keys = list(keys)
    names = [rule[0] for rule in CATEGORY_RULES]
    combos = parsed.groupBy(*keys, *names).agg(F.count(F.lit(1)).cast("double").alias("c"))
    items = []
    for column, prefix, minimum, dropped, suffix in CATEGORY_RULES:
        value = F.coalesce(F.col(column), F.lit("none"))
        keep = ~value.isin(*dropped) if dropped else F.lit(True)
        if suffix:
            keep = keep & ~value.endswith(suffix)
        label = F.concat(F.lit(prefix), F.lower(F.regexp_replace(value, " ", "_")))
        items.append(F.struct(F.when(keep, label).alias("column"), F.lit(float(minimum)).alias("min_total")))
    long = combos.select(*keys, "c", F.explode(F.array(*items)).alias("i"))
    return (
        long.where(F.col("i.column").isNotNull())
        .groupBy(*keys, F.col("i.column").alias("column"), F.col("i.min_total").alias("min_total"))
        .agg(F.sum("c").alias("value"))
    )


def frequent_columns(counts: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Category columns whose total count reaches the threshold, per `within` key."""
    total = counts.groupBy(*within, "column", "min_total").agg(F.sum("value").alias("total"))
    return total.where(F.col("total") >= F.col("min_total")).select(*within, "column", "total")


def frequent_category_counts(parsed: DataFrame, keys: Sequence[str] = ("session", "company")) -> DataFrame:
    counts = category_counts(parsed, keys)
    kept = frequent_columns(counts).select("column")
    return counts.join(kept, "column", "left_semi").select(*keys, "column", "value")
