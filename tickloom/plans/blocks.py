"""Feature blocks by name and the session feature matrix.

Blocks are functions of (inputs, parameters). Session-local blocks give plain columns. Two things depend on the
set of sessions a model is trained on, and are described rather than baked in: category columns, which
exist only where their total count reaches a threshold and stay rows (session, column, value), and TF-IDF vocabularies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.text import document_text
from tickloom.operators import documents, matrix, price, reaction, sequence, summary, tfidf
from tickloom.plans.news import News
from tickloom.session import materialize


@dataclass(frozen=True)
class FeatureSpec:
    """One block of features: a named one, or a caller's `build` (inputs, params) -> one row per session."""

    name: str
    params: dict = field(default_factory=dict)
    alias: str | None = None
    build: Callable[[Inputs, dict], DataFrame | None] | None = None

    @property
    def resolved_alias(self) -> str:
        return self.alias or self.name


def bar_features(name: str, function: Callable[[DataFrame], DataFrame]) -> FeatureSpec:
    """A caller's function from seen bars to (session, features) as a block."""
    return FeatureSpec(name, build=lambda inputs, params: function(inputs.seen))


@dataclass
class Inputs:
    """Seen bars and headlines of one set of sessions; shared intermediates are computed once."""

    bars: DataFrame
    headlines: DataFrame
    sessions: DataFrame
    columns: tuple[str, ...] | None = None  # of the parsed headlines, all if None

    @cached_property
    def news(self) -> News:
        return News(matrix.restrict(self.headlines, self.sessions), self.columns)

    def parse_for(self, specs: Sequence[FeatureSpec]) -> None:
        """Parse only what the blocks read. Headlines parsed for fewer columns are parsed again, all columns."""
        wanted = parsed_columns(specs)
        if "news" not in self.__dict__:
            self.columns = wanted
        elif self.columns is not None and (wanted is None or not set(wanted) <= set(self.columns)):
            self.columns = None
            del self.__dict__["news"]

    @cached_property
    def seen(self) -> DataFrame:
        return matrix.restrict(self.bars, self.sessions)


def headline_features(i: Inputs, with_bars: bool = True) -> DataFrame:
    """Summary, slots, weighted sums and sequence statistics, with price reactions when bars are used.

    The weighted category sums that go with them are `Inputs.news.category_sums`.
    """
    out = i.news.text_features().join(
        sequence.sequence_features(i.news.spread, i.news.cells), "session", "left"
    )
    if with_bars:
        reactions = reaction.reaction_features(i.news.cells, i.news.relevance, i.seen)
        out = out.join(reactions, "session", "left")
    return out


def _regime(i: Inputs, params: dict) -> DataFrame:
    wanted = params.get("include_columns")
    if wanted is not None and not isinstance(wanted, list):
        raise ValueError("include_columns must be a list.")
    block = reaction.regime_features(i.news.cells, i.news.relevance, i.seen)
    return matrix.pick_columns(block, wanted or None)


def _numeric_part(i: Inputs, params: dict, company: bool) -> DataFrame | None:
    if not params.get("include_numeric", False):
        return None
    return i.news.text_features(int(params.get("top_k", 2))) if company else headline_features(i)


BLOCKS: dict[str, Callable[[Inputs, dict], DataFrame | None]] = {
    "price": lambda i, p: price.price_block(i.seen),
    "price_technical": lambda i, p: price.technical_block(i.seen),
    "headline_parser": lambda i, p: headline_features(i),
    "headline_sequence": lambda i, p: sequence.sequence_features(i.news.spread, i.news.cells),
    "headline_regime_context": _regime,
    "headline_tfidf": lambda i, p: _numeric_part(i, p, company=False),
    "headline_company_tfidf": lambda i, p: _numeric_part(i, p, company=True),
}


TEXT_BLOCKS = ("headline_tfidf", "headline_company_tfidf")


# What documents and features read of the parsed headlines. Texts for vectors are not among it.
DOCUMENT_COLUMNS = ("session", "pos", "headline", "company", "body", "event_family")
FEATURE_COLUMNS = (
    *DOCUMENT_COLUMNS, "bar_ix", "verb_family", "topic", "geography", "counterparty", "amount_m", "pct", "polarity", "has_amount", "has_pct"
)


def parsed_columns(specs: Sequence[FeatureSpec]) -> tuple[str, ...] | None:
    """Columns of the parsed headlines that the blocks read; None, for all, with a caller's own block among them."""
    if any(s.build for s in specs):
        return None
    news = [s for s in specs if s.name.startswith("headline_")]
    if all(s.name == "headline_tfidf" and not s.params.get("include_numeric", False) for s in news):
        read = {str(s.params.get("text_source", "body")) for s in news}
        return tuple(c for c in DOCUMENT_COLUMNS if c in ("session", "pos") or c in read or (c in ("company", "body") and "company_body" in read))
    return FEATURE_COLUMNS


def has_categories(spec: FeatureSpec) -> bool:
    """Whether weighted category sums belong to a block."""
    if spec.build:
        return False
    return spec.name == "headline_parser" or (spec.name in TEXT_BLOCKS and bool(spec.params.get("include_numeric", False)))


@dataclass
class TextBlock:
    """Term counts per (slot, session) of one TF-IDF block; slot 0 is the session's own document."""

    alias: str
    counts: DataFrame
    slots: int
    labels: list[str]
    min_df: int
    max_features: int

    @property
    def columns(self) -> list[str]:
        return [f"{self.alias}__{label}__{i:03d}" for label in self.labels for i in range(1, self.max_features + 1)]


def _text_block(spec: FeatureSpec, i: Inputs) -> TextBlock | None:
    if spec.build or spec.name not in TEXT_BLOCKS:
        return None
    p = spec.params
    text = document_text(str(p.get("text_source", "body")))
    ngram_max = int(p.get("ngram_max", 2))
    if spec.name == "headline_tfidf":
        parts = documents.document_parts(i.news.parsed, ["session"], text).withColumn("slot", F.lit(0))
        slots, labels = 1, ["session_text"]
    else:
        slots = int(p.get("top_k", 2))
        top = summary.top_companies(i.news.relevance, slots).select("session", "company", (F.col("slot") - 1).alias("slot"))
        parts = documents.document_parts(i.news.parsed, ["session", "company"], text)
        parts = parts.join(top, ["session", "company"]).drop("company")
        labels = [f"top{s}_text" for s in range(1, slots + 1)]
    counts = materialize(tfidf.term_counts(parts, ["slot", "session"], ngram_max), "terms")
    features = int(p.get("max_features", 256))
    if features <= 0:
        # All terms are wanted: the matrix is as wide as the largest vocabulary.
        widest = counts.groupBy("slot").agg(F.countDistinct("term").alias("n")).agg(F.max("n")).head()[0]
        features = int(widest or 0)
    return TextBlock(spec.resolved_alias, counts, slots, labels, int(p.get("min_df", 2)), features)


@dataclass
class FeatureMatrix:
    """Session-local columns in one written table, with what depends on the training sessions on the side."""

    df: DataFrame
    columns: dict[str, list[str]]  # block alias -> column names
    texts: dict[str, TextBlock]
    category_aliases: list[str]  # blocks whose columns include `alias__w_<category>` for the frequent categories
    inputs: Inputs

    def all_columns(self) -> list[str]:
        return [c for names in self.columns.values() for c in names]


def check_specs(specs: Sequence[FeatureSpec]) -> None:
    if not specs:
        raise ValueError("At least one feature block is needed.")
    seen: dict[str, FeatureSpec] = {}
    for spec in specs:
        if spec.build is None and spec.name not in BLOCKS:
            raise ValueError(f"Unknown feature block {spec.name!r}; known: {', '.join(sorted(BLOCKS))}.")
        if seen.setdefault(spec.resolved_alias, spec) is not spec:
            raise ValueError(f"Feature block alias {spec.resolved_alias!r} is used twice.")


def build_feature_matrix(specs: Sequence[FeatureSpec], inputs: Inputs) -> FeatureMatrix:
    """All blocks side by side on the session spine, named alias__column, nulls 0; category columns are not among them."""
    check_specs(specs)
    inputs.parse_for(specs)
    blocks, columns, texts = [], {}, {}
    for spec in specs:
        alias = spec.resolved_alias
        block = (spec.build or BLOCKS[spec.name])(inputs, spec.params)
        columns[alias] = []
        if block is not None:
            blocks.append((alias, block))
            names = [c for c in block.columns if c != "session"]
            columns[alias] = [f"{alias}__{c}" for c in names]
        text = _text_block(spec, inputs)
        if text is not None:
            texts[alias] = text
    df = materialize(matrix.concat_blocks(inputs.sessions, blocks), "matrix")
    return FeatureMatrix(df, columns, texts, [s.resolved_alias for s in specs if has_categories(s)], inputs)
