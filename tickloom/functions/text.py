"""Headline grammar as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import lexicon

_BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]+"
# The same characters, to strip them from the ends of a text.
_BLANK_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)
MAX_COMPANY_TOKENS = 4
# The fewest leading words, each with its space, whose remainder opens an event.
_COMPANY = f"^((?:[^ ]+ ){{1,{MAX_COMPANY_TOKENS}}}?)(?:" + "|".join(re.escape(s) for s in lexicon.EVENT_STARTERS) + ")"


def single_spaced(text: Column) -> Column:
    """The words of a text without blanks at its ends, one space apart."""
    return F.regexp_replace(text, _BLANKS, " ")


def alnum_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(lexicon.TOKEN_PATTERN), F.lit(0))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def company_length(spaced: Column, opening: Column) -> Column:
    """Leading words of a single-spaced text that name the company: the shortest run whose remainder opens an event.

    `opening` is that run in lower case with its last space, as `company_opening` gives it.
    """
    return F.when(opening != "", _spaces(opening)).when(_spaces(spaced) >= 2, F.lit(2)).otherwise(F.lit(1))


def company_opening(spaced: Column) -> Column:
    return F.regexp_extract(F.lower(spaced), _COMPANY, 1)


def _first(entries: Column, test: Callable[[Column], Column]) -> Column:
    """The first entry of a constant array that passes the test, else null.

    Lists are data here: spelled out as conditions, one headline's code grows past what the JVM compiles.
    """
    return F.get(F.filter(entries, test), F.lit(0))


def verb_family(body: Column) -> Column:
    """The opening phrase or first word of a lower-case event text."""
    phrases = F.array(*[F.lit(p) for p in lexicon.VERB_PHRASES])
    phrase = F.replace(_first(phrases, body.startswith), F.lit(" "), F.lit("_"))
    return F.when(body == "", F.lit("unknown")).otherwise(F.coalesce(phrase, F.substring_index(body, " ", 1)))


def rule_number(body: Column) -> Column:
    """1-based number of the first event rule whose fragments all occur in a lower-case event text, else 0."""
    most = max(len(fragments) for _, _, _, fragments in lexicon.EVENT_RULES)
    rules = []
    for number, (_, _, _, fragments) in enumerate(lexicon.EVENT_RULES, 1):
        padded = [*fragments, *[""] * (most - len(fragments))]  # every text holds the empty one
        rules.append(F.struct(F.lit(number).alias("number"), *[F.lit(f).alias(f"f{i}") for i, f in enumerate(padded)]))
    holds = lambda rule: reduce(and_, [body.contains(rule[f"f{i}"]) for i in range(most)])
    return F.coalesce(_first(F.array(*rules), holds)["number"], F.lit(0))


def default_polarity(verb: Column) -> Column:
    default = F.lit(0)
    for sign in (1, -1):
        listed = [v for v, p in lexicon.DEFAULT_POLARITY_BY_VERB.items() if p == sign]
        default = F.when(verb.isin(listed), F.lit(sign)).otherwise(default)
    return default


def by_rule(rule: Column, position: int, otherwise: Column) -> Column:
    """The rule's entry at `position`, from one constant array."""
    entries = F.array(*[F.lit(r[position]) for r in lexicon.EVENT_RULES])
    return F.when(rule > 0, F.element_at(entries, rule)).otherwise(otherwise)


def amount_m(text: Column) -> Column:
    """First dollar amount in millions, 0 if none."""
    number = F.regexp_extract(text, lexicon.AMOUNT_PATTERN, 1)
    unit = F.regexp_extract(text, lexicon.AMOUNT_PATTERN, 2)
    value = F.when(number != "", number.cast("double")).otherwise(F.lit(0.0))
    return F.when(~text.contains("$"), F.lit(0.0)).when(unit == "B", value * 1000.0).otherwise(value)


def percent(text: Column) -> Column:
    number = F.regexp_extract(text, lexicon.PERCENT_PATTERN, 1)
    return F.when(text.contains("%") & (number != ""), number.cast("double")).otherwise(F.lit(0.0))


def longest_match(lowered: Column, candidates: Sequence[str]) -> Column:
    """The longest listed phrase contained in a lower-case text, else 'none'."""
    phrases = [F.struct(F.lit(p).alias("phrase"), F.lit(p.lower()).alias("lower")) for p in sorted(candidates, key=len, reverse=True)]
    return F.coalesce(_first(F.array(*phrases), lambda p: lowered.contains(p["lower"]))["phrase"], F.lit("none"))


def normalized(text: Column) -> Column:
    """Lower-case alphanumeric tokens joined by a space.

    Percentages become the two tokens `pct token`. Amounts stay: their pattern needs an upper-case
    unit and is looked for in lower-case text.
    """
    lowered = F.lower(text)
    masked = F.when(lowered.contains("%"), F.regexp_replace(lowered, lexicon.PERCENT_PATTERN, " pct_token ")).otherwise(lowered)
    return F.trim(F.regexp_replace(masked, "[^a-z0-9]+", " "))


def parse_headlines(headlines: DataFrame) -> DataFrame:
    """Add the fifteen parsed columns to a table with a `headline` column (null becomes '')."""
    text, body, body_lower = F.col("__text"), F.col("body"), F.col("__body")
    verb, rule = F.col("__verb"), F.col("__rule")
    parsed = (
        headlines.withColumn("headline", F.coalesce("headline", F.lit("")))
        .withColumn("__text", F.btrim("headline", F.lit(_BLANK_CHARACTERS)))
        .withColumn("__spaced", single_spaced(text))
        .withColumn("__opening", company_opening(F.col("__spaced")))
        .withColumn("company", F.call_function("substring_index", "__spaced", F.lit(" "), company_length(F.col("__spaced"), F.col("__opening"))))
        .withColumn("body", F.substring("__spaced", F.length("company") + 2, F.length("__spaced")))
        .withColumn("__body", F.lower(body))
        .withColumn("__verb", verb_family(body_lower))
        .withColumns({"__lower": F.lower(text), "__rule": rule_number(body_lower), "__normalized": normalized(body)})
        .withColumns(
            {
                "event_text": body,
                # Blanks part company and body, and no token holds one.
                "headline_normalized": F.trim(F.concat_ws(" ", normalized(F.col("company")), "__normalized")),
                "event_text_normalized": F.col("__normalized"),
                "verb_family": by_rule(rule, 1, verb),
                "event_family": by_rule(rule, 0, F.concat(verb, F.lit("_other"))),
                "topic": longest_match(F.col("__lower"), lexicon.TOPICS),
                "geography": longest_match(F.col("__lower"), lexicon.GEOGRAPHIES),
                "counterparty": longest_match(F.col("__lower"), lexicon.COUNTERPARTIES),
                "amount_m": amount_m(text),
                "pct": percent(text),
                "polarity": by_rule(rule, 2, default_polarity(verb)).cast("int"),
            }
        )
        .withColumns(
            {"has_amount": (F.col("amount_m") > 0).cast("int"), "has_pct": (F.col("pct") > 0).cast("int")}
        )
    )
    return parsed.drop("__text", "__spaced", "__opening", "__body", "__verb", "__lower", "__rule", "__normalized")


# Text a document is built from (lower-cased).
DOCUMENT_SOURCES = ("headline", "body", "company_body", "event_family")
# Column a vector is looked up by.
VECTOR_SOURCES = {
    "headline": "headline",
    "event": "event_text",
    "headline_normalized": "headline_normalized",
    "event_normalized": "event_text_normalized",
}


def document_text(source: str) -> Column:
    if source not in DOCUMENT_SOURCES:
        raise ValueError(f"text_source must be one of {DOCUMENT_SOURCES}, not {source!r}.")
    if source == "company_body":
        return F.trim(F.lower(F.concat_ws(" ", F.coalesce("company", F.lit("")), F.coalesce("body", F.lit("")))))
    return F.lower(F.coalesce(F.col(source), F.lit("")))


def vector_text(source: str) -> Column:
    if source not in VECTOR_SOURCES:
        raise ValueError(f"text_source must be one of {sorted(VECTOR_SOURCES)}, not {source!r}.")
    return F.coalesce(F.col(VECTOR_SOURCES[source]), F.lit(""))
