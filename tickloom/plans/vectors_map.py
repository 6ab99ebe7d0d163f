"""Vector feature blocks and the multi-block vector feature map."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tickloom.operators import reaction, sequence, summary, vectors
from tickloom.operators.matrix import align_sessions, prefix_columns
from tickloom.plans.news import News

# Relevance columns added by default to company-weighted blocks.
RELEVANCE_SUMMARY = [
    "n_companies",
    "top_company_share",
    "top_recent_share",
    "top1_relevance",
    "top1_weight",
    "top2_relevance",
    "top2_weight",
    "relevance_gap",
    "weight_gap",
    "company_entropy",
    "relevance_entropy",
    "company_concentration",
    "relevance_concentration",
]

AGGREGATIONS = ("company_weighted", "session")


@dataclass(frozen=True)
class VectorBlock:
    name: str
    text_source: str = "event_normalized"
    aggregation: str = "company_weighted"
    include_relevance_summary: bool = True
    include_structured_features: bool = False
    include_sequence_features: bool = False
    include_price_interactions: bool = False


DEFAULT_BLOCKS = (
    VectorBlock("text_cw_event_norm", aggregation="company_weighted"),
    VectorBlock("text_session_event_norm", aggregation="session"),
)


def vector_block(news: News, table: DataFrame, block: VectorBlock, dims: int, bars: DataFrame | None = None) -> DataFrame:
    """One block: aggregated vectors of a (text, embedding) table with the chosen structured add-ons."""
    if block.aggregation not in AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {AGGREGATIONS}, not {block.aggregation!r}.")
    if block.include_price_interactions and bars is None:
        raise ValueError("Price interactions need bars.")
    if block.aggregation == "session":
        out = vectors.session_vectors(news.spread, table, block.text_source, dims)
    else:
        out = vectors.company_weighted_vectors(news.spread, news.relevance, table, block.text_source, dims)
    if block.include_structured_features:
        out = out.join(news.wide_text_features(), "session", "left")
    elif block.include_relevance_summary and block.aggregation == "company_weighted":
        relevance = summary.relevance_summary(news.scored).select("session", *RELEVANCE_SUMMARY)
        out = out.join(relevance, "session", "left")
    if block.include_sequence_features:
        out = out.join(sequence.sequence_features(news.spread, news.cells), "session", "left")
    if block.include_price_interactions:
        out = out.join(reaction.reaction_features(news.cells, news.relevance, bars), "session", "left")
    return out.na.fill(0.0)


def vector_feature_map(
    news: News,
    table: DataFrame,
    sessions: DataFrame,
    blocks: Sequence[VectorBlock] = DEFAULT_BLOCKS,
    bars: DataFrame | None = None,
    dims: int | None = None,
) -> DataFrame:
    """Blocks side by side with name__ prefixes, one row per session, nulls 0."""
    names = [b.name.strip() for b in blocks]
    if not all(names):
        raise ValueError("Every vector block needs a name.")
    if len(set(names)) < len(names):
        raise ValueError("Vector block names must differ.")
    dims = vectors.dimensions(table) if dims is None else dims
    out = sessions.select("session").distinct()
    for name, block in zip(names, blocks):
        out = out.join(prefix_columns(vector_block(news, table, block, dims, bars), name), "session", "left")
    return align_sessions(out, sessions)
