"""Shared intermediate tables of the headline features, each computed once.

Company features feed several aggregates and joins. Without a cut every one of them would parse the headlines
again, so the parsed events, their cells and the company table are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tickloom.operators.companies import category_counts, company_aggregates, company_session, frequent_columns, score_relevance
from tickloom.operators.events import event_cells, parsed_events
from tickloom.operators.summary import TOP_K, session_text_features, weighted_category_sums
from tickloom.session import dealt, materialize

MAX_WIDE = 1000  # category columns of a wide table


@dataclass
class News:
    """`columns` are those of the parsed table that are wanted, all if None: the others are neither computed nor written."""

    headlines: DataFrame
    columns: Sequence[str] | None = None

    @cached_property
    def parsed(self) -> DataFrame:
        events = parsed_events(self.headlines)
        return materialize(events if self.columns is None else events.select(*[c for c in events.columns if c in self.columns]), "events")

    @cached_property
    def spread(self) -> DataFrame:
        """`parsed` in tasks of a bounded number of rows, for aggregates nearly as fine as the headlines."""
        return dealt(self.parsed, [c for c in ("session", "bar_ix", "pos") if c in self.parsed.columns])

    @cached_property
    def cells(self) -> DataFrame:
        """Cells of the parsed headlines; without a parsed table they come straight from the headlines, and no text is written."""
        parsed = self.spread if "parsed" in self.__dict__ else parsed_events(self.headlines)
        return materialize(event_cells(parsed), "cells")

    @cached_property
    def relevance(self) -> DataFrame:
        """Company aggregates with shares, relevance score and weight, from the cells alone: no text order, no sequences."""
        if "scored" in self.__dict__:
            return self.scored
        return materialize(score_relevance(company_aggregates(self.cells), rank=False), "relevance")

    @cached_property
    def companies(self) -> DataFrame:
        return materialize(company_session(self.spread, self.cells), "companies")

    @cached_property
    def scored(self) -> DataFrame:
        """Company features with shares, relevance score and weight."""
        return materialize(score_relevance(self.companies, rank=False), "scored")

    @cached_property
    def ranked(self) -> DataFrame:
        """`relevance` with the full relevance rank."""
        return score_relevance(company_aggregates(self.cells), rank=True)

    @cached_property
    def category_counts(self) -> DataFrame:
        """Long category counts per (session, company), before any threshold."""
        return materialize(category_counts(self.parsed), "categories")

    @cached_property
    def category_sums(self) -> DataFrame:
        """Relevance-weighted category counts as rows (session, column, value), whatever the number of categories."""
        counts = self.category_counts.select("session", "company", "column", "value")
        sums = weighted_category_sums(self.relevance, counts)
        return materialize(sums.select("session", F.expr("substring(feature, 3)").alias("column"), "value"), "category-sums")

    def text_features(self, k: int = TOP_K) -> DataFrame:
        """Sums, summary, slots and weighted sums. Categories stay rows (`category_sums`)."""
        return session_text_features(self.scored, k=k)

    def wide_text_features(self, k: int = TOP_K) -> DataFrame:
        """`text_features` with a column for every category that reaches its threshold over all these headlines."""
        frequent = frequent_columns(self.category_counts).select("column").distinct()
        names = [r["column"] for r in frequent.orderBy("column").limit(MAX_WIDE + 1).collect()]
        if len(names) > MAX_WIDE:
            raise ValueError(f"More than {MAX_WIDE} categories reach their threshold; take them as rows from category_sums.")
        counts = self.category_counts.select("session", "company", "column", "value")
        return session_text_features(self.scored, counts, k, [f"w_{c}" for c in names])
