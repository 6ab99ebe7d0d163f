"""All queries of the subpackage; importing the operator modules registers them."""

from tickloom.llm import (  # noqa: F401
    decontaminate,
    language_id,
    lm_score,
    mixing,
    ngram_join,
    ranked_search,
    sharding,
    substring_dedup,
    token_counts,
    topk,
    toxicity,
    url_filter,
    whitening,
)
from tickloom.llm.common import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
