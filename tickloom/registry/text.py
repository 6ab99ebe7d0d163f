"""Queries over headlines: parsing, events, companies, sequences, summaries, reactions, documents, vectors."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from tickloom.functions import lexicon
from tickloom.functions.text import document_text, normalized, parse_headlines, vector_text
from tickloom.operators import companies, documents, events, reaction, sequence, summary, tfidf, vectors
from tickloom.plans.news import News
from tickloom.registry import common as c
from tickloom.registry.common import query, tidy, tidy_sql
from tickloom.session import checkpoint_dir, dealt, materialize, spread_scan
from tickloom.sources import adapters

D = "session:i"
DIMS = 64

# --- SQL fragments --------------------------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_q(i) if isinstance(i, str) else str(i) for i in items) + "]"


def _longest(column: str, phrases) -> str:
    whens = " ".join(
        f"WHEN contains({column}, {_q(p.lower())}) THEN {_q(p)}" for p in sorted(phrases, key=len, reverse=True)
    )
    return f"CASE {whens} ELSE 'none' END"


_START = "^(" + "|".join(lexicon.EVENT_STARTERS) + ")"
_RULE = " ".join(
    "WHEN " + " AND ".join(f"contains(lb, {_q(f)})" for f in rule[3]) + f" THEN {i}"
    for i, rule in enumerate(lexicon.EVENT_RULES, 1)
)
_VERBS = " ".join(f"WHEN starts_with(lb, {_q(p)}) THEN {_q(p.replace(' ', '_'))}" for p in lexicon.VERB_PHRASES)
_DEFAULT = " ".join(f"WHEN {_q(v)} THEN {p}" for v, p in lexicon.DEFAULT_POLARITY_BY_VERB.items())


def _normal(text: str) -> str:
    return (
        f"array_to_string(regexp_extract_all(regexp_replace(lower({text}), '(\\d+(?:\\.\\d+)?)%', ' pct_token ', 'g'), "
        "'[a-z0-9]+'), ' ')"
    )


_PARSE = f"""
w AS (SELECT *, trim(headline) AS txt,
             list_filter(regexp_split_to_array(trim(headline), '\\s+'), lambda x: x <> '') AS tok FROM headlines),
k AS (SELECT *, CASE {' '.join(
    f"WHEN {i} <= least(4, greatest(len(tok) - 1, 1)) AND regexp_matches(lower(array_to_string(tok[{i + 1}:], ' ')), '{_START}') THEN {i}"
    for i in range(1, 5))} WHEN len(tok) >= 3 THEN 2 ELSE 1 END AS k FROM w),
b AS (SELECT *, array_to_string(tok[1:k], ' ') AS company, array_to_string(tok[k + 1:], ' ') AS body,
             lower(array_to_string(tok[k + 1:], ' ')) AS lb, lower(txt) AS lt FROM k),
v AS (SELECT *, CASE {_RULE} ELSE 0 END AS rule,
             CASE WHEN lb = '' THEN 'unknown' {_VERBS} ELSE split_part(lb, ' ', 1) END AS verb FROM b),
parsed AS (
  SELECT session, bar_ix, pos, headline, company, body, body AS event_text, {_normal('txt')} AS headline_normalized,
    {_normal('body')} AS event_text_normalized,
    CASE WHEN rule = 0 THEN verb ELSE {_list([r[1] for r in lexicon.EVENT_RULES])}[rule] END AS verb_family,
    CASE WHEN rule = 0 THEN verb || '_other' ELSE {_list([r[0] for r in lexicon.EVENT_RULES])}[rule] END AS event_family,
    {_longest('lt', lexicon.TOPICS)} AS topic, {_longest('lt', lexicon.GEOGRAPHIES)} AS geography,
    {_longest('lt', lexicon.COUNTERPARTIES)} AS counterparty,
    CASE WHEN regexp_matches(txt, '\\$\\d+(\\.\\d+)?[MB]')
         THEN CAST(regexp_extract(txt, '\\$(\\d+(?:\\.\\d+)?)([MB])', 1) AS DOUBLE)
              * CASE regexp_extract(txt, '\\$(\\d+(?:\\.\\d+)?)([MB])', 2) WHEN 'B' THEN 1000 ELSE 1 END
         ELSE 0 END AS amount_m,
    CASE WHEN regexp_matches(txt, '\\d%') THEN CAST(regexp_extract(txt, '(\\d+(?:\\.\\d+)?)%', 1) AS DOUBLE) ELSE 0 END AS pct,
    CASE WHEN rule = 0 THEN CASE verb {_DEFAULT} ELSE 0 END
         ELSE {_list([r[2] for r in lexicon.EVENT_RULES])}[rule] END AS polarity
  FROM v),
ev0 AS (SELECT *, CASE WHEN amount_m > 0 THEN 1 ELSE 0 END AS has_amount, CASE WHEN pct > 0 THEN 1 ELSE 0 END AS has_pct,
               CAST(max(bar_ix) OVER (PARTITION BY session) AS DOUBLE) AS session_max_bar FROM parsed)"""

_EVENTS = (
    _PARSE
    + """,
ev1 AS (SELECT *, abs(polarity) AS polarity_abs,
    CASE WHEN polarity > 0 THEN 1.0 ELSE 0.0 END AS positive_flag, CASE WHEN polarity < 0 THEN 1.0 ELSE 0.0 END AS negative_flag,
    CASE WHEN polarity = 0 THEN 1.0 ELSE 0.0 END AS neutral_flag, abs(pct) AS pct_abs, pct * polarity AS pct_signed,
    session_max_bar - bar_ix AS bars_from_end, bar_ix / greatest(session_max_bar, 1.0) AS bar_fraction,
    CASE WHEN session_max_bar - bar_ix <= 9 THEN 1.0 ELSE 0.0 END AS is_recent,
    CASE WHEN session_max_bar - bar_ix <= 4 THEN 1.0 ELSE 0.0 END AS is_very_recent,
    CASE WHEN bar_ix / greatest(session_max_bar, 1.0) <= 0.5 THEN 1.0 ELSE 0.0 END AS is_early_half,
    CASE WHEN bar_ix / greatest(session_max_bar, 1.0) <= 0.5 THEN 0.0 ELSE 1.0 END AS is_late_half,
    CASE WHEN polarity <> 0 AND (has_pct > 0 OR has_amount > 0 OR NOT ends_with(event_family, '_other')) THEN 1.0 ELSE 0.0 END AS is_strong_event
  FROM ev0),
events_t AS (SELECT *, positive_flag * is_recent AS late_positive_flag, negative_flag * is_recent AS late_negative_flag,
    neutral_flag * is_recent AS late_neutral_flag, is_strong_event * is_recent AS late_strong_flag FROM ev1)"""
)
EVENTS = c.HEADLINES + "," + _EVENTS


def _sequence_sql(tag: str, keys: str) -> str:
    return f""",
o_{tag} AS (SELECT {keys}, bar_ix, headline, polarity, is_strong_event, session_max_bar,
           bar_ix - lag(bar_ix) OVER (PARTITION BY {keys} ORDER BY bar_ix, headline) AS gap FROM events_t),
f_{tag} AS (SELECT {keys}, bar_ix, headline, sign(polarity) AS s,
           lag(sign(polarity)) OVER (PARTITION BY {keys} ORDER BY bar_ix, headline) AS ps FROM events_t WHERE polarity <> 0),
fl_{tag} AS (SELECT {keys}, sum(CASE WHEN s <> ps THEN 1.0 ELSE 0.0 END) AS flips, count(*) AS active FROM f_{tag} GROUP BY {keys}),
b_{tag} AS (SELECT {keys}, bar_ix, count(*) AS n FROM events_t GROUP BY {keys}, bar_ix),
bb_{tag} AS (SELECT {keys}, max(n) AS mx, sum(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS multi FROM b_{tag} GROUP BY {keys}),
g_{tag} AS (SELECT {keys}, max(session_max_bar) AS smb, coalesce(avg(gap), 0) AS gm, coalesce(stddev_pop(gap), 0) AS gs,
           max(CASE WHEN is_strong_event > 0 THEN bar_ix END) AS ls FROM o_{tag} GROUP BY {keys}),
seq_{tag} AS (SELECT {keys}, coalesce(flips, 0) AS polarity_flip_count,
           CASE WHEN active > 1 THEN flips / (active - 1) ELSE 0 END AS polarity_flip_rate,
           coalesce(smb - ls, smb + 1) AS time_since_last_strong_event, gm AS headline_gap_mean,
           gs / greatest(gm, 1.0) AS headline_gap_cv, CASE WHEN gs + gm > 0 THEN (gs - gm) / (gs + gm) ELSE 0 END AS headline_burstiness,
           mx AS max_headlines_single_bar, multi AS multi_headline_bar_count,
           multi / greatest(smb + 1, 1.0) AS multi_headline_bar_share
         FROM g_{tag} JOIN bb_{tag} USING ({keys}) LEFT JOIN fl_{tag} USING ({keys}))"""


_COMPANY = (
    _EVENTS
    + _sequence_sql("c", "session, company")
    + """,
ca AS (SELECT session, company, count(*) AS headline_count, sum(is_recent) AS recent_headline_count,
    sum(is_very_recent) AS very_recent_headline_count, sum(is_early_half) AS early_half_headline_count,
    sum(is_late_half) AS late_half_headline_count, count(DISTINCT bar_ix) AS bar_coverage, max(bar_ix) AS last_bar_ix,
    avg(bar_ix) AS mean_bar_ix, sum(positive_flag) AS positive_count, sum(negative_flag) AS negative_count,
    sum(neutral_flag) AS neutral_count, sum(late_positive_flag) AS late_positive_count,
    sum(late_negative_flag) AS late_negative_count, sum(late_neutral_flag) AS late_neutral_count,
    sum(is_strong_event) AS strong_event_count, sum(late_strong_flag) AS late_strong_event_count,
    sum(polarity) AS polarity_sum, sum(polarity_abs) AS polarity_abs_sum, sum(amount_m) AS amount_sum_m,
    max(amount_m) AS amount_max_m, sum(pct) AS pct_sum, sum(pct_abs) AS pct_abs_sum, max(pct_abs) AS pct_abs_max,
    sum(pct_signed) AS pct_signed_sum, sum(has_amount) AS has_amount_count, sum(has_pct) AS has_pct_count
  FROM events_t GROUP BY session, company),
company AS (SELECT *, least(positive_count, negative_count) / greatest(positive_count + negative_count, 1.0) AS conflict_score,
    headline_count / greatest(bar_coverage, 1.0) AS headline_density FROM ca JOIN seq_c USING (session, company)),
sh AS (SELECT *, headline_count / greatest(sum(headline_count) OVER p, 1.0) AS mention_share,
    recent_headline_count / greatest(sum(recent_headline_count) OVER p, 1.0) AS recent_share,
    early_half_headline_count / greatest(sum(early_half_headline_count) OVER p, 1.0) AS early_share,
    late_half_headline_count / greatest(sum(late_half_headline_count) OVER p, 1.0) AS late_share,
    bar_coverage / greatest(sum(bar_coverage) OVER p, 1.0) AS bar_coverage_share,
    last_bar_ix / greatest(max(last_bar_ix) OVER p, 1.0) AS last_bar_ix_norm
  FROM company WINDOW p AS (PARTITION BY session)),
sc AS (SELECT *, 0.35 * mention_share + 0.30 * recent_share + 0.20 * bar_coverage_share + 0.15 * last_bar_ix_norm AS relevance_score FROM sh),
sx AS (SELECT *, exp(relevance_score - max(relevance_score) OVER (PARTITION BY session)) AS ex FROM sc),
scored AS (SELECT *, ex / greatest(sum(ex) OVER (PARTITION BY session), 1e-9) AS relevance_weight,
    row_number() OVER (PARTITION BY session ORDER BY round(relevance_score, 12) DESC, company) AS relevance_rank,
    row_number() OVER (PARTITION BY session ORDER BY round(relevance_score, 12) DESC, headline_count DESC, company) AS slot
  FROM sx)"""
)
COMPANY = c.HEADLINES + "," + _COMPANY
BARS_COMPANY = c.BARS_HEADLINES + "," + _COMPANY

# --- builders -------------------------------------------------------------------------------


def news(spark, sf_dir) -> News:
    return News(c.headlines(spark, sf_dir))


def parsed(spark, sf_dir):
    """Parsed headlines for queries that use them once."""
    return events.parsed_events(c.headlines(spark, sf_dir))


# --- parsing and events ---------------------------------------------------------------------

_PARSED_COLUMNS = (
    "session:i bar_ix:i pos:i headline:s company:s body:s event_text:s headline_normalized:s event_text_normalized:s "
    "verb_family:s event_family:s topic:s geography:s counterparty:s amount_m pct polarity:i has_amount:i has_pct:i"
)


@query("parse_headlines", tidy_sql(EVENTS, _PARSED_COLUMNS, "events_t"))
def parse_headlines_query(spark, sf_dir):
    return tidy(parse_headlines(c.headlines(spark, sf_dir)))


@query(
    "normalised_text",
    tidy_sql(
        f"q AS (SELECT doc_id, {_normal('text')} AS normalized FROM documents)",
        "doc_id:i normalized:s",
        "q",
    ),
)
def normalised_text(spark, sf_dir):
    docs = spread_scan(adapters.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tidy(docs.select("doc_id", normalized(F.col("text")).alias("normalized")))


_FLAGS = (
    "polarity_abs:i positive_flag negative_flag neutral_flag pct_abs pct_signed session_max_bar bars_from_end bar_fraction "
    "is_recent is_very_recent is_early_half is_late_half is_strong_event late_positive_flag late_negative_flag "
    "late_neutral_flag late_strong_flag"
)


@query("event_table", tidy_sql(EVENTS, f"{_PARSED_COLUMNS} {_FLAGS}", "events_t"))
def event_table(spark, sf_dir):
    return tidy(events.event_table(c.headlines(spark, sf_dir)))


# --- companies ------------------------------------------------------------------------------

_COMPANY_COLUMNS = " ".join(
    [D, "company:s", *companies.COMPANY_COLUMNS, *sequence.SEQUENCE_COLUMNS, "conflict_score", "headline_density"]
)


@query("company_session", tidy_sql(COMPANY, _COMPANY_COLUMNS, "company"))
def company_session(spark, sf_dir):
    n = news(spark, sf_dir)
    return tidy(companies.company_session(n.parsed, n.cells))


_CATEGORIES = """,
cat0 AS (
  SELECT session, company, 'event__' || lower(replace(event_family, ' ', '_')) AS col, 25 AS m FROM events_t WHERE NOT ends_with(event_family, '_other')
  UNION ALL SELECT session, company, 'topic__' || lower(replace(topic, ' ', '_')), 1 FROM events_t WHERE topic <> 'none'
  UNION ALL SELECT session, company, 'geo__' || lower(replace(geography, ' ', '_')), 1 FROM events_t WHERE geography <> 'none'
  UNION ALL SELECT session, company, 'verb__' || lower(replace(verb_family, ' ', '_')), 10 FROM events_t WHERE verb_family <> 'unknown'
  UNION ALL SELECT session, company, 'counterparty__' || lower(replace(counterparty, ' ', '_')), 20 FROM events_t WHERE counterparty <> 'none'),
catk AS (SELECT col FROM cat0 GROUP BY col HAVING count(*) >= max(m)),
cats AS (SELECT session, company, col AS "column", count(*) AS value FROM cat0 WHERE col IN (SELECT col FROM catk) GROUP BY session, company, col)"""


@query("category_counts_long", tidy_sql(EVENTS + _CATEGORIES, f"{D} company:s column:s value", "cats"))
def category_counts_long(spark, sf_dir):
    return tidy(companies.frequent_category_counts(parsed(spark, sf_dir)))


@query(
    "company_relevance",
    tidy_sql(COMPANY, " ".join([D, "company:s", *companies.RELEVANCE_COLUMNS]), "scored", 9),
)
def company_relevance(spark, sf_dir):
    return tidy(news(spark, sf_dir).ranked.select("session", "company", *companies.RELEVANCE_COLUMNS), 9)


@query(
    "sequence_session",
    tidy_sql(EVENTS + _sequence_sql("s", "session"), " ".join([D, *sequence.SEQUENCE_COLUMNS]), "seq_s"),
)
def sequence_session(spark, sf_dir):
    n = news(spark, sf_dir)
    return tidy(sequence.sequence_features(n.parsed, n.cells))


@query(
    "sequence_company",
    tidy_sql(EVENTS + _sequence_sql("c", "session, company"), " ".join([D, "company:s", *sequence.SEQUENCE_COLUMNS]), "seq_c"),
)
def sequence_company(spark, sf_dir):
    n = news(spark, sf_dir)
    return tidy(sequence.sequence_features(n.parsed, n.cells, ("session", "company")))


# --- session summary ------------------------------------------------------------------------


def _second(x: str) -> str:
    return f"coalesce(list(CAST({x} AS DOUBLE) ORDER BY {x} DESC)[2], 0)"


def _entropy(x: str) -> str:
    return f"coalesce(-sum(CASE WHEN {x} > 0 THEN {x} * ln({x}) END), 0)"


def _margin(x: str) -> str:
    return (
        f"CASE WHEN sum({x}) > 0 THEN (max({x}) - {_second(x)}) / sum({x}) ELSE 0 END"
    )


_SUMMARY = (
    ",\nsm AS (SELECT session, "
    + ", ".join(f"sum({x}) AS {x}" for x in summary.ADDITIVE_COLUMNS)
    + f""",
    count(*) AS n_companies, sum(bar_coverage) AS headline_bar_coverage_sum, avg(headline_density) AS headline_density_mean,
    max(mention_share) AS top_company_share, max(recent_share) AS top_recent_share, max(relevance_score) AS top1_relevance,
    max(relevance_weight) AS top1_weight, {_second('relevance_score')} AS top2_relevance, {_second('relevance_weight')} AS top2_weight,
    {_entropy('mention_share')} AS company_entropy, {_entropy('relevance_weight')} AS relevance_entropy,
    sum(mention_share * mention_share) AS company_concentration, sum(relevance_weight * relevance_weight) AS relevance_concentration,
    avg(conflict_score) AS conflict_score_mean, max(conflict_score) AS conflict_score_max,
    sum(relevance_weight * conflict_score) AS weighted_conflict_score,
    coalesce(1 - abs(sum(CASE WHEN positive_count + negative_count > 0 THEN relevance_weight * sign(polarity_sum) END))
               / sum(CASE WHEN positive_count + negative_count > 0 THEN relevance_weight END), 0) AS weighted_polarity_disagreement,
    {_margin('positive_count')} AS positive_company_margin, {_margin('negative_count')} AS negative_company_margin,
    {_margin('strong_event_count')} AS strong_event_company_margin,
    0.5 * sum(abs(early_share - late_share)) AS relevance_instability,
    CASE WHEN sum(early_half_headline_count) > 0 AND sum(late_half_headline_count) > 0
              AND list(company ORDER BY early_share DESC, company)[1] <> list(company ORDER BY late_share DESC, company)[1]
         THEN 1 ELSE 0 END AS top_company_switch_flag
  FROM scored GROUP BY session),
summary AS (SELECT *, top1_relevance - top2_relevance AS relevance_gap, top1_weight - top2_weight AS weight_gap,
    company_entropy / CASE WHEN n_companies <= 1 THEN 1 ELSE ln(n_companies) END AS company_entropy_norm,
    relevance_entropy / CASE WHEN n_companies <= 1 THEN 1 ELSE ln(n_companies) END AS relevance_entropy_norm FROM sm)"""
)


@query(
    "session_text_summary",
    tidy_sql(COMPANY + _SUMMARY, " ".join([D, *summary.ADDITIVE_COLUMNS, *summary.SUMMARY_COLUMNS]), "summary", 8),
)
def session_text_summary(spark, sf_dir):
    return tidy(summary.relevance_summary(news(spark, sf_dir).scored), 8)


_SLOT_NAMES = [f"top{s}_{x}" for s in (1, 2) for x in summary.SLOT_COLUMNS]
_SLOTS = (
    ",\nslots AS (SELECT session, "
    + ", ".join(f"coalesce(max(CASE WHEN slot = {s} THEN {x} END), 0) AS top{s}_{x}" for s in (1, 2) for x in summary.SLOT_COLUMNS)
    + " FROM scored GROUP BY session)"
)


@query("company_slots", tidy_sql(COMPANY + _SLOTS, " ".join([D, *_SLOT_NAMES]), "slots", 9))
def company_slots(spark, sf_dir):
    return tidy(summary.company_slots(news(spark, sf_dir).scored).na.fill(0.0), 9)


_WEIGHTED = (
    ",\nweighted AS (SELECT session, "
    + ", ".join(f"sum(relevance_weight * {x}) AS w_{x}" for x in summary.SLOT_COLUMNS)
    + " FROM scored GROUP BY session)"
)


@query(
    "weighted_sums",
    tidy_sql(COMPANY + _WEIGHTED, " ".join([D, *[f"w_{x}" for x in summary.SLOT_COLUMNS]]), "weighted"),
)
def weighted_sums(spark, sf_dir):
    return tidy(summary.weighted_sums(news(spark, sf_dir).scored))


_WEIGHTED_CATEGORIES = (
    _CATEGORIES
    + """,
wcat AS (SELECT session, 'w_' || "column" AS feature, sum(relevance_weight * value) AS value
         FROM cats JOIN scored USING (session, company) GROUP BY session, feature)"""
)


@query("weighted_category_sums", tidy_sql(COMPANY + _WEIGHTED_CATEGORIES, f"{D} feature:s value", "wcat"))
def weighted_category_sums(spark, sf_dir):
    n = news(spark, sf_dir)
    counts = companies.frequent_category_counts(n.parsed)  # first: the cells then come from the parsed table too
    return tidy(summary.weighted_category_sums(n.relevance, counts))


# --- news against prices --------------------------------------------------------------------

_CONTEXT = """,
ctx AS (SELECT session, bar_ix, coalesce(close / lag(close) OVER w - 1, 0) AS bar_return,
    (high - low) / greatest(open, 1e-6) AS intrabar_range_ratio,
    coalesce((lead(close) OVER w - close) / greatest(close, 1e-6), 0) AS next_close_return,
    (last_value(close) OVER (PARTITION BY session ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - close)
      / greatest(close, 1e-6) AS return_to_seen_end,
    lag(close) OVER w / greatest(max(close) OVER (PARTITION BY session ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e-6) - 1 AS pre_event_drawdown,
    (lag(close) OVER w - lag(close, 2) OVER w) / greatest(lag(close, 2) OVER w, 1e-6) AS pre_event_return_1,
    (lag(close) OVER w - lag(close, 4) OVER w) / greatest(lag(close, 4) OVER w, 1e-6) AS pre_event_return_3,
    (lag(close) OVER w - lag(close, 6) OVER w) / greatest(lag(close, 6) OVER w, 1e-6) AS pre_event_return_5
  FROM seen WINDOW w AS (PARTITION BY session ORDER BY bar_ix)),
ctx2 AS (SELECT *,
    stddev_pop(bar_return) OVER (PARTITION BY session ORDER BY bar_ix ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pre_event_vol_3,
    stddev_pop(bar_return) OVER (PARTITION BY session ORDER BY bar_ix ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pre_event_vol_5,
    avg(intrabar_range_ratio) OVER (PARTITION BY session ORDER BY bar_ix ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pre_event_range_3,
    avg(intrabar_range_ratio) OVER (PARTITION BY session ORDER BY bar_ix ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pre_event_range_5
  FROM ctx),
act AS (SELECT e.session, e.polarity, c2.* EXCLUDE (session), s.relevance_weight AS w, s.relevance_rank AS rk
        FROM events_t e LEFT JOIN ctx2 c2 ON e.session = c2.session AND e.bar_ix = c2.bar_ix
        JOIN scored s ON e.session = s.session AND e.company = s.company WHERE e.polarity <> 0)"""

_REACTION = (
    _CONTEXT
    + """,
ag AS (SELECT session, avg(sign(return_to_seen_end) * polarity) AS headline_price_agreement_mean,
    avg(sign(next_close_return) * polarity) AS headline_price_next_bar_agreement_mean,
    sum(w * sign(return_to_seen_end) * polarity) / sum(w) AS headline_price_agreement_weighted,
    sum(w * return_to_seen_end * polarity) / sum(w) AS headline_signed_seen_reaction_weighted,
    sum(w * next_close_return * polarity) / sum(w) AS headline_signed_next_bar_reaction_weighted,
    coalesce(avg(CASE WHEN rk = 1 THEN return_to_seen_end * polarity END), 0) AS high_relevance_signed_seen_reaction_mean,
    coalesce(avg(CASE WHEN rk = 1 THEN sign(return_to_seen_end) * polarity END), 0) AS high_relevance_agreement_mean,
    coalesce(avg(CASE WHEN polarity > 0 THEN return_to_seen_end END), 0) AS positive_headline_seen_return_mean,
    coalesce(avg(CASE WHEN polarity < 0 THEN return_to_seen_end END), 0) AS negative_headline_seen_return_mean
  FROM act GROUP BY session)"""
)
_BURST = """,
hc AS (SELECT session, bar_ix, count(*) AS n FROM events_t GROUP BY session, bar_ix),
bm AS (SELECT x.session, bar_return, intrabar_range_ratio,
    sum(coalesce(n, 0)) OVER (PARTITION BY x.session ORDER BY x.bar_ix ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 2 AS burst
  FROM ctx2 x LEFT JOIN hc ON x.session = hc.session AND x.bar_ix = hc.bar_ix),
bu AS (SELECT session, avg(CASE WHEN burst THEN 1.0 ELSE 0.0 END) AS burst_bar_share,
    coalesce(stddev_pop(CASE WHEN burst THEN bar_return END), 0) AS burst_window_volatility,
    coalesce(stddev_pop(CASE WHEN burst THEN bar_return END), 0) / greatest(stddev_pop(bar_return), 1e-6) AS burst_window_volatility_ratio,
    coalesce(avg(CASE WHEN burst THEN intrabar_range_ratio END), 0) AS burst_window_range_mean
  FROM bm GROUP BY session)"""


def reaction_frame(spark, sf_dir):
    placed = c.placed_ticks(spark, sf_dir)
    n = News(adapters.headlines_from_ticks(dealt(placed, ["session", "pos"])))
    return n.cells, n.relevance, materialize(adapters.seen(adapters.bars_from_ticks(placed)), "bars")


@query(
    "price_interaction",
    tidy_sql(
        BARS_COMPANY + _REACTION + _BURST + ",\nq AS (SELECT * FROM bu JOIN ag USING (session))",
        " ".join([D, *reaction.REACTION_COLUMNS]),
        "q",
    ),
)
def price_interaction(spark, sf_dir):
    return tidy(reaction.reaction_features(*reaction_frame(spark, sf_dir)))


@query(
    "burst_windows",
    tidy_sql(BARS_COMPANY + _CONTEXT + _BURST, " ".join([D, *[x for x in reaction.REACTION_COLUMNS if x.startswith("burst")]]), "bu"),
)
def burst_windows(spark, sf_dir):
    placed = c.placed_ticks(spark, sf_dir)
    cells = events.event_cells(events.parsed_events(adapters.headlines_from_ticks(placed)))
    context = reaction.reaction_context(adapters.seen(adapters.bars_from_ticks(placed)))
    return tidy(reaction.burst_features(cells, context))


def _z(x: str) -> str:
    return f"coalesce({x}, 0)"


def _regime_sql() -> str:
    out = []
    names = [f"pre_event_return_{k}" for k in (1, 3, 5)] + ["pre_event_vol_3", "pre_event_vol_5", "pre_event_range_3", "pre_event_range_5", "pre_event_drawdown"]
    for n in names:
        out.append(f"avg({_z(n)}) AS {n}_mean")
    for n in ("pre_event_return_3", "pre_event_return_5", "pre_event_vol_3", "pre_event_vol_5"):
        out.append(f"sum(w * {_z(n)}) / sum(w) AS weighted_{n}_mean")
    for k in (3, 5):
        out.append(f"sum(w * -polarity * {_z(f'pre_event_return_{k}')}) / sum(w) AS weighted_contrarian_return_{k}_mean")
        out.append(f"sum(w * polarity / greatest({_z(f'pre_event_vol_{k}')}, 1e-6)) / sum(w) AS weighted_vol_scaled_polarity_{k}_mean")
    out.append(f"sum(w * -polarity * {_z('pre_event_drawdown')}) / sum(w) AS weighted_drawdown_contrarian_mean")
    for side, op in (("positive", ">"), ("negative", "<")):
        for n in ("pre_event_return_3", "pre_event_drawdown"):
            out.append(f"coalesce(avg(CASE WHEN polarity {op} 0 THEN {_z(n)} END), 0) AS {side}_{n}_mean")
    return ",\nreg AS (SELECT session, " + ", ".join(out) + " FROM act GROUP BY session)"


_REGIME = _CONTEXT + _regime_sql()


@query(
    "regime_context",
    tidy_sql(BARS_COMPANY + _REGIME, " ".join([D, *reaction.REGIME_COLUMNS]), "reg", 8),
)
def regime_context(spark, sf_dir):
    return tidy(reaction.regime_features(*reaction_frame(spark, sf_dir)), 8)


# --- documents and TF-IDF -------------------------------------------------------------------

_DOCS = """,
sdoc AS (SELECT session, 0 AS part, string_agg(lower(body), ' ' ORDER BY pos) AS text FROM events_t WHERE trim(body) <> '' GROUP BY session),
cdoc AS (SELECT session, company, 0 AS part, string_agg(lower(body), ' ' ORDER BY pos) AS text FROM events_t WHERE trim(body) <> '' GROUP BY session, company)"""


def _parts_sql(keys: str, span: int = documents.PART_SPAN) -> str:
    return f""",
parts AS (SELECT {keys}, CAST(floor(pos / {span}) AS BIGINT) AS part, string_agg(lower(body), ' ' ORDER BY pos) AS text
          FROM events_t WHERE trim(body) <> '' GROUP BY {keys}, floor(pos / {span}))"""


@query("session_documents", tidy_sql(EVENTS + _parts_sql("session"), f"{D} part:i text:s", "parts"))
def session_documents(spark, sf_dir):
    return tidy(documents.document_parts(parsed(spark, sf_dir), ["session"], document_text("body")))


@query("session_documents_in_parts", tidy_sql(EVENTS + _parts_sql("session", 97), f"{D} part:i text:s", "parts"))
def session_documents_in_parts(spark, sf_dir):
    """A span so small that every session is several parts."""
    return tidy(documents.document_parts(parsed(spark, sf_dir), ["session"], document_text("body"), span=97))


@query("company_documents", tidy_sql(EVENTS + _parts_sql("session, company"), f"{D} company:s part:i text:s", "parts"))
def company_documents(spark, sf_dir):
    return tidy(documents.document_parts(parsed(spark, sf_dir), ["session", "company"], document_text("body")))


def _vocab_sql(source: str, doc: str, scope: str = "", n_docs: str = "", cap: int = 256) -> str:
    """Terms, vocabulary and weights of `source`(scope.., doc, text)."""
    s = f"{scope}, " if scope else ""
    part = f"PARTITION BY {scope} " if scope else ""
    join = f"USING ({s}term)"
    return f""",
tk AS (SELECT {s}{doc}, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM {source}),
grams AS (SELECT {s}{doc}, unnest(t) AS term FROM tk
          UNION ALL SELECT {s}{doc}, unnest([t[i] || '_' || t[i + 1] for i in range(1, len(t))]) FROM tk WHERE len(t) >= 2),
tc AS (SELECT {s}{doc}, term, count(*) AS n FROM grams GROUP BY {s}{doc}, term),
vs AS (SELECT {s}term, count(*) AS df, sum(n) AS tf FROM tc GROUP BY {s}term HAVING count(*) >= 2),
vr AS (SELECT *, row_number() OVER ({part}ORDER BY tf DESC, df DESC, term) AS position FROM vs),
nd AS (SELECT count(*) AS nd FROM {n_docs}),
vocab AS (SELECT vr.*, ln((1 + nd) / (1.0 + df)) + 1 AS idf FROM vr, nd WHERE position <= {cap}),
raw AS (SELECT {s}{doc}, term, position, n / sum(n) OVER (PARTITION BY {s}{doc}) * idf AS x FROM tc JOIN vocab {join}),
tfidf AS (SELECT {s}{doc}, term, position, x / sqrt(sum(x * x) OVER (PARTITION BY {s}{doc})) AS weight FROM raw)"""


_DOC_VOCAB = "d0 AS (SELECT doc_id, text FROM documents)" + _vocab_sql("d0", "doc_id", n_docs="documents")


def _document_counts(spark, sf_dir):
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = spread_scan(docs)
    able = tfidf.able_terms(docs, "doc_id", 2, 256)
    return docs, materialize(tfidf.term_counts(docs, ["doc_id"], 2, single_part=True, only=able), "terms")


@query("tfidf_vocabulary", tidy_sql(_DOC_VOCAB, "term:s df:i tf:i position:i idf", "vocab"))
def tfidf_vocabulary(spark, sf_dir):
    docs, counts = _document_counts(spark, sf_dir)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return tidy(tfidf.vocabulary(counts, n_docs, min_df=2, max_features=256))


@query("tfidf_documents", tidy_sql(_DOC_VOCAB, "doc_id:i term:s position:i weight", "tfidf"))
def tfidf_documents(spark, sf_dir):
    docs, counts = _document_counts(spark, sf_dir)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    vocab = tfidf.vocabulary(counts, n_docs, min_df=2, max_features=256)
    return tidy(tfidf.tfidf(counts, vocab, ["doc_id"], vocab_rows=256))


@query(
    "tfidf_session",
    tidy_sql(
        EVENTS + _DOCS + _vocab_sql("sdoc", "session", n_docs="(SELECT DISTINCT session FROM ticks)"),
        f"{D} term:s position:i weight",
        "tfidf",
    ),
)
def tfidf_session(spark, sf_dir):
    placed = c.placed_ticks(spark, sf_dir)
    p = events.parsed_events(adapters.headlines_from_ticks(placed))
    parts = documents.document_parts(p, ["session"], document_text("body"))
    counts = materialize(tfidf.term_counts(parts, ["session"], 2), "terms")
    n_docs = placed.select("session").distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    vocab = tfidf.vocabulary(counts, n_docs)
    return tidy(tfidf.tfidf(counts, vocab, ["session"], vocab_rows=256))


_SLOT_DOCS = """,
slotdoc AS (SELECT slot, cdoc.session, text FROM cdoc JOIN scored USING (session, company) WHERE slot <= 2)"""


@query(
    "tfidf_company",
    tidy_sql(
        COMPANY + _DOCS + _SLOT_DOCS + _vocab_sql("slotdoc", "session", "slot", "(SELECT DISTINCT session FROM ticks)", 192),
        f"slot:i {D} term:s position:i weight",
        "tfidf",
    ),
)
def tfidf_company(spark, sf_dir):
    placed = c.placed_ticks(spark, sf_dir)
    n = News(adapters.headlines_from_ticks(dealt(placed, ["session", "pos"])))
    n.parsed  # once, for the cells and the documents  # noqa: B018
    top = summary.top_companies(n.relevance, 2).select("session", "company", "slot")
    parts = documents.document_parts(n.parsed, ["session", "company"], document_text("body"))
    slotted = parts.join(top, ["session", "company"]).drop("company")
    counts = materialize(tfidf.term_counts(slotted, ["slot", "session"], 2), "terms")
    n_docs = placed.select("session").distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    vocab = tfidf.vocabulary(
        counts, n_docs.crossJoin(spark.range(1, 3).select(F.col("id").cast("int").alias("slot"))), ["slot"], 2, 192
    )
    return tidy(tfidf.tfidf(counts, vocab, ["slot", "session"], ["slot"], vocab_rows=384))


# --- vectors --------------------------------------------------------------------------------

_VECTORS = """,
nv AS (SELECT count(*) AS nv FROM embeddings),
txt AS (SELECT DISTINCT event_text_normalized AS text FROM events_t WHERE event_text_normalized <> ''),
tv AS (SELECT text, embedding FROM txt, nv JOIN embeddings ON vec_id = CAST('0x' || substr(md5(text), 1, 7) AS BIGINT) % nv)"""


def _text_vectors(spark, sf_dir, p):
    texts = p.select(vector_text("event_normalized").alias("text"))
    return adapters.text_vectors(texts, adapters.table(spark, sf_dir, "embeddings"))


def _long_vectors(df, prefixes):
    """Wide vector columns to (session, block, dim, value), for compact comparison."""
    items = [
        F.struct(F.lit(p).alias("block"), F.lit(i).alias("dim"), F.col(f"{p}{i:03d}").alias("value"))
        for p in prefixes
        for i in range(DIMS)
    ]
    return df.select("session", F.explode(F.array(*items)).alias("i")).select("session", "i.*")


_UNNEST = """,
ev AS (SELECT e.session, e.company, e.is_recent, unnest(range(64)) AS dim, unnest(CAST(tv.embedding AS DOUBLE[])) AS x
       FROM events_t e JOIN tv ON e.event_text_normalized = tv.text)"""


@query(
    "vector_session_mean",
    tidy_sql(
        EVENTS + _VECTORS + _UNNEST
        + ",\nq AS (SELECT session, 'session_emb_' AS block, dim, avg(x) AS value FROM ev GROUP BY session, dim)",
        f"{D} block:s dim:i value",
        "q",
    ),
)
def vector_session_mean(spark, sf_dir):
    p = news(spark, sf_dir).parsed
    wide = vectors.session_vectors(p, _text_vectors(spark, sf_dir, p), "event_normalized", DIMS)
    return tidy(_long_vectors(wide, ["session_emb_"]))


@query(
    "vector_recent_weighted",
    tidy_sql(
        EVENTS + _VECTORS + _UNNEST
        + """,
q AS (SELECT session, 'recent_emb_' AS block, dim, sum(is_recent * x) / greatest(sum(is_recent), 1e-9) AS value
      FROM ev GROUP BY session, dim)""",
        f"{D} block:s dim:i value",
        "q",
    ),
)
def vector_recent_weighted(spark, sf_dir):
    p = news(spark, sf_dir).parsed
    wide = vectors.session_vectors(p, _text_vectors(spark, sf_dir, p), "event_normalized", DIMS)
    return tidy(_long_vectors(wide, ["recent_emb_"]))


@query(
    "vector_company_weighted",
    tidy_sql(
        COMPANY + _VECTORS + _UNNEST
        + """,
cm AS (SELECT session, company, dim, avg(x) AS m, sum(is_recent * x) / greatest(sum(is_recent), 1e-9) AS r
       FROM ev GROUP BY session, company, dim),
q AS (SELECT session, 'weighted_emb_' AS block, dim, sum(relevance_weight * m) AS value FROM cm JOIN scored USING (session, company) GROUP BY session, dim
      UNION ALL
      SELECT session, 'weighted_recent_emb_', dim, sum(relevance_weight * r) FROM cm JOIN scored USING (session, company) GROUP BY session, dim)""",
        f"{D} block:s dim:i value",
        "q",
    ),
)
def vector_company_weighted(spark, sf_dir):
    n = news(spark, sf_dir)
    found = _text_vectors(spark, sf_dir, n.parsed)
    wide = vectors.company_weighted_vectors(n.parsed, n.relevance, found, "event_normalized", DIMS)
    return tidy(_long_vectors(wide, ["weighted_emb_", "weighted_recent_emb_"]))


# The cache holds the texts of the first five bars; later bars bring the missing ones.
_CACHE = """,
early AS (SELECT DISTINCT headline_normalized AS text FROM events_t WHERE bar_ix < 5 AND headline_normalized <> ''),
recent AS (SELECT DISTINCT headline_normalized AS text FROM events_t WHERE is_recent = 1 AND headline_normalized <> '')"""

_HEADLINE_VECTORS = """,
nv AS (SELECT count(*) AS nv FROM embeddings),
txt AS (SELECT DISTINCT headline_normalized AS text FROM events_t WHERE headline_normalized <> ''),
tv AS (SELECT text, embedding FROM txt, nv JOIN embeddings ON vec_id = CAST('0x' || substr(md5(text), 1, 7) AS BIGINT) % nv)"""


def _headline_texts(frame):
    return frame.select(vector_text("headline_normalized").alias("text"))


@query(
    "missing_texts",
    tidy_sql(
        EVENTS + _HEADLINE_VECTORS + _CACHE
        + ",\nq AS (SELECT text FROM txt WHERE text NOT IN (SELECT text FROM early))",
        "text:s",
        "q",
    ),
)
def missing_texts(spark, sf_dir):
    p = news(spark, sf_dir).parsed
    embeddings = adapters.table(spark, sf_dir, "embeddings")
    cache = adapters.text_vectors(_headline_texts(p.where(F.col("bar_ix") < 5)), embeddings)
    return tidy(vectors.missing_texts(_headline_texts(p), cache))


@query(
    "vector_cache_merge",
    tidy_sql(
        EVENTS + _HEADLINE_VECTORS + _CACHE
        + """,
q AS (SELECT text, len(embedding) AS dims,
             list_sum(CAST(embedding AS DOUBLE[])) * CASE WHEN text IN (SELECT text FROM recent) THEN 2 ELSE 1 END AS total
      FROM tv WHERE text IN (SELECT text FROM early) OR text IN (SELECT text FROM recent))""",
        "text:s dims:i total",
        "q",
    ),
)
def vector_cache_merge(spark, sf_dir):
    """The early cache, with the recent texts encoded anew (doubled vectors): the new vector is kept."""
    headlines = c.headlines(spark, sf_dir)
    table = materialize(events.event_table(headlines), "events")
    embeddings = adapters.table(spark, sf_dir, "embeddings")
    cache = adapters.text_vectors(_headline_texts(table.where(F.col("bar_ix") < 5)), embeddings)
    fresh = adapters.text_vectors(_headline_texts(table.where(F.col("is_recent") == 1)), embeddings)
    doubled = F.transform("embedding", lambda x: (x * 2).cast("float"))
    merged = vectors.merge_cache(cache, fresh.select("text", doubled.alias("embedding")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return tidy(merged.select("text", F.size("embedding").alias("dims"), total.alias("total")))


_ENCODED = """,
wd AS (SELECT text, unnest(string_split(text, ' ')) AS w FROM txt),
hs AS (SELECT text, ('0x' || substr(md5(w), 1, 7))::BIGINT % 64 AS dim,
              CASE WHEN ('0x' || substr(md5(w), 8, 1))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END AS s FROM wd WHERE w <> ''),
sm AS (SELECT text, dim, sum(s) AS v FROM hs GROUP BY text, dim),
q AS (SELECT text, dim, (v / sqrt(sum(v * v) OVER (PARTITION BY text)))::FLOAT AS value FROM sm)"""


@query(
    "encode_texts",
    tidy_sql(EVENTS + _HEADLINE_VECTORS + _ENCODED + ",\nz AS (SELECT * FROM q WHERE value <> 0)", "text:s dim:i value", "z"),
)
def encode_texts(spark, sf_dir):
    """Distinct event texts through the batch encoder into a cache table, in two updates that overlap; the entries that are not 0.

    The early texts are then appended once more, negated and right again, and the cache is compacted.
    """
    p = news(spark, sf_dir).parsed
    path = f"{checkpoint_dir(spark).rstrip('/')}/vector-cache-{uuid.uuid4().hex}"
    encoder = partial(vectors.hashed_words, DIMS)
    vectors.update_cache(path, _headline_texts(p.where(F.col("bar_ix") < 5)), encoder)
    vectors.update_cache(path, _headline_texts(p), encoder)
    early = vectors.cached(path, _headline_texts(p.where(F.col("bar_ix") < 5)))
    early = materialize(early, "early")
    for sign in (-1, 1):
        vectors.append_cache(path, early.select("text", F.transform("embedding", lambda x: (x * sign).cast("float")).alias("embedding")))
    vectors.compact_cache(spark, path)
    done = vectors.read_cache(spark, path)
    return tidy(done.select("text", F.posexplode("embedding").alias("dim", "value")).where("value <> 0"))
