import random
import re
from pathlib import Path

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import lexicon
from tickloom.functions.text import document_text, longest_match, parse_headlines, rule_number, verb_family
from tickloom.operators import companies, documents, events, reaction, sequence, summary, tfidf, vectors
from tickloom.operators.matrix import align_sessions
from tickloom.plans.news import News
from tickloom.plans.vectors_map import VectorBlock, vector_feature_map
from tickloom.sources.schemas import BARS, HEADLINES, TEXT_VECTORS

CASES = {
    None: ("", "", "unknown_other", 0),
    "": ("", "", "unknown_other", 0),
    "Relbos": ("Relbos", "", "unknown_other", 0),
    "Relbos wins": ("Relbos", "wins", "wins_other", 1),
    "one two three four five six seven eight": ("one two", "three four five six seven eight", "three_other", 0),
    "Winsome Corp wins industry award": ("Winsome Corp", "wins industry award", "industry_award", 1),
    "A winsome Corp wins x": ("A", "winsome Corp wins x", "winsome_other", 0),
    "Acme chief operating officer steps down unexpectedly": ("Acme", "chief operating officer steps down unexpectedly", "executive_departure", -1),
    "Acme to host investor day": ("Acme", "to host investor day", "investor_day", 0),
    "Acme chief strategy officer resigns": ("Acme", "chief strategy officer resigns", "chief_strategy_officer_other", -1),
    "  Acme   secures  a contract with x ": ("Acme", "secures a contract with x", "contract_win", 1),
}


@pytest.fixture(scope="module")
def parsed_cases(spark):
    rows = [(1, 0, i, h) for i, h in enumerate(CASES)]
    return {r["pos"]: r for r in parse_headlines(spark.createDataFrame(rows, HEADLINES)).collect()}


def test_company_body_and_event(parsed_cases):
    for i, (company, body, family, polarity) in enumerate(CASES.values()):
        r = parsed_cases[i]
        assert (r.company, r.body, r.event_family, r.polarity) == (company, body, family, polarity)
    # The first rule with the same fragment wins.
    assert parsed_cases[7].verb_family == "cfo"


def test_amounts_percents_and_dictionaries(spark):
    rows = [
        "Acme reports $5m", "Acme reports $5M then $7B", "Acme secures $1.5B", "Acme misses by 12.5% not 3%",
        "Acme expands in Central Europe", "Acme expands in Europe", "Acme expands across asia pacific markets",
        "Acme sees data analytics and cloud infrastructure",
    ]
    df = parse_headlines(spark.createDataFrame([(1, 0, i, h) for i, h in enumerate(rows)], HEADLINES))
    r = [x for x in df.orderBy("pos").collect()]
    assert [x.amount_m for x in r[:3]] == [0.0, 5.0, 1500.0] and r[0].has_amount == 0 and r[2].has_amount == 1
    assert (r[3].pct, r[3].has_pct) == (12.5, 1)
    assert r[3].headline_normalized == "acme misses by pct token not pct token"
    assert r[1].headline_normalized == "acme reports 5m then 7b"
    assert [x.geography for x in r[4:8]] == ["Central Europe", "Europe", "Asia Pacific", "none"]
    assert r[7].topic == "cloud infrastructure"


def random_headlines(n=400, sessions=4, seed=5):
    rng = random.Random(seed)
    bodies = ["wins industry award", "delays product launch in Europe", "holds quiet period", "withdraws from Scandinavia",
              "reports record quarterly revenue of $3M", "misses quarterly revenue estimates by 4%"]
    names = ["Relbos", "Alvis Corp", "Yorvof Systems"]
    out = []
    for i in range(n):
        # Session 0 holds most rows; many are copies.
        s = 0 if rng.random() < 0.6 else rng.randrange(1, sessions)
        out.append((s, rng.randrange(0, 12), i, f"{rng.choice(names)} {rng.choice(bodies)}"))
    return out


@pytest.fixture(scope="module")
def news(spark):
    return News(spark.createDataFrame(random_headlines(), HEADLINES))


def flips_by_hand(pdf, keys):
    out = {}
    for key, g in pdf[pdf.polarity != 0].sort_values(["bar_ix", "headline"]).groupby(keys):
        s = g["polarity"].tolist()
        out[key if isinstance(key, tuple) else (key,)] = sum(a != b for a, b in zip(s, s[1:]))
    return out


@pytest.mark.parametrize("keys", [["session"], ["session", "company"]])
def test_flips_over_range_partitions(news, keys):
    want = flips_by_hand(news.parsed.toPandas(), keys)
    got = {tuple(r[k] for k in keys): r["polarity_flip_count"] for r in sequence.polarity_flips(news.parsed, keys).collect()}
    assert got == want


def test_relevance_weights_sum_to_one(news):
    w = news.scored.groupBy("session").agg(F.sum("relevance_weight").alias("w")).toPandas()["w"]
    assert w.to_numpy() == pytest.approx([1.0] * len(w))
    ranks = news.ranked.groupBy("session").agg(F.sort_array(F.collect_list("relevance_rank")).alias("r")).collect()
    assert all(r["r"] == [float(i + 1) for i in range(len(r["r"]))] for r in ranks)


def test_one_company_and_tied_companies(spark):
    rows = [(1, 3, 0, "Relbos wins industry award")]
    rows += [(2, 3, i, f"{c} wins industry award") for i, c in enumerate(["Beta", "Alpha"])]
    n = News(spark.createDataFrame(rows, HEADLINES))
    s = {r["session"]: r for r in summary.relevance_summary(n.scored).collect()}
    assert s[1]["top2_relevance"] == 0.0 and s[1]["company_entropy_norm"] == 0.0 and s[1]["positive_company_margin"] == 1.0
    assert s[2]["positive_company_margin"] == 0.0 and s[2]["company_entropy_norm"] == pytest.approx(1.0)
    top = summary.top_companies(n.scored, 2).where("session = 2").orderBy("slot").collect()
    assert [r["company"] for r in top] == ["Alpha", "Beta"]


def test_category_thresholds(spark):
    def heads(session, verb, n):
        return [(session, i % 5, i, f"Relbos {verb}") for i in range(n)]

    rows = heads(1, "wins industry award", 24) + heads(2, "delays product launch", 25) + heads(3, "opens x", 9)
    rows += heads(4, "warns y", 10) + heads(5, "signs with a global retailer", 19)
    rows = [(s, b, 1000 * s + p, h) for s, b, p, h in rows]
    parsed = events.parsed_events(spark.createDataFrame(rows, HEADLINES))
    names = {r["column"] for r in companies.frequent_category_counts(parsed).collect()}
    assert "event__product_launch_delay" in names and "event__industry_award" not in names
    assert "verb__warns" in names and "verb__opens" not in names
    assert "counterparty__a_global_retailer" not in names


def test_reaction_with_missing_bars(spark):
    bars = spark.createDataFrame([(1, i, 1.0, 1.2, 0.9, 1.0 + 0.1 * i) for i in range(3)] + [(9, 0, 1.0, 1.0, 1.0, 1.0)], BARS)
    rows = [(1, 0, 0, "Relbos wins industry award"), (1, 7, 1, "Relbos wins industry award"), (2, 0, 0, "Relbos wins x")]
    n = News(spark.createDataFrame(rows, HEADLINES))
    got = {r["session"]: r for r in reaction.reaction_features(n.cells, n.scored, bars).collect()}
    assert set(got) == {1, 2}
    # Plain means skip the headline without a bar; weighted forms become 0.
    assert got[1]["headline_price_agreement_mean"] == 1.0 and got[1]["headline_price_agreement_weighted"] == 0.0
    assert got[1]["positive_headline_seen_return_mean"] == pytest.approx(0.2)
    assert got[2]["burst_bar_share"] == 0.0
    regime = {r["session"]: r for r in reaction.regime_features(n.cells, n.scored, bars).collect()}
    # No volatility before the first bar: polarity over the floor.
    assert regime[2]["weighted_vol_scaled_polarity_3_mean"] == pytest.approx(1e6)
    spine = spark.createDataFrame([(1,), (9,)], "session long")
    assert align_sessions(sequence.sequence_features(n.parsed, n.cells), spine).where("session = 9").head()["headline_gap_mean"] == 0.0


@pytest.mark.parametrize("ngram_max", [1, 2, 3])
def test_parts_give_the_same_terms_as_the_whole_document(news, ngram_max):
    def counts(span):
        parts = documents.document_parts(news.parsed, ["session"], document_text("body"), span=span)
        c = tfidf.term_counts(parts, ["session"], ngram_max)
        return {(r["session"], r["term"]): r["n"] for r in c.collect()}, parts.count()

    whole, one = counts(1_000_000)
    split, many = counts(3)
    assert one == 4 and many > 50
    assert split == whole


def test_seams_through_one_token_parts(spark):
    parts = spark.createDataFrame([(1, p, t) for p, t in enumerate("a b c d e".split())], "doc int, part int, text string")
    got = {r["term"]: r["n"] for r in tfidf.term_counts(parts, ["doc"], 3).collect()}
    assert got == {k: 1 for k in "a b c d e a_b b_c c_d d_e a_b_c b_c_d c_d_e".split()}


def test_tfidf_norms_and_vocabulary_limits(spark, news):
    parts = documents.document_parts(news.parsed, ["session"], document_text("company_body"))
    counts = tfidf.term_counts(parts, ["session"], 2)
    n_docs = spark.createDataFrame([(5,)], "n_docs long")
    vocab = tfidf.vocabulary(counts, n_docs, min_df=2, max_features=10)
    assert vocab.count() == 10
    norms = tfidf.tfidf(counts, vocab, ["session"]).groupBy("session").agg(F.sum(F.col("weight") * F.col("weight")).alias("q"))
    assert norms.toPandas()["q"].to_numpy() == pytest.approx([1.0] * 4)
    assert tfidf.vocabulary(counts, n_docs, min_df=99).count() == 0
    assert tfidf.vocabulary(counts, n_docs, min_df=1, max_features=0).count() == counts.select("term").distinct().count()
    with pytest.raises(ValueError):
        document_text("nope")


def test_vector_cache_and_lookup(spark):
    cache = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], TEXT_VECTORS)
    texts = spark.createDataFrame([("a",), ("c",), ("",), (None,), ("c",)], "text string")
    assert [r["text"] for r in vectors.missing_texts(texts, cache).collect()] == ["c"]
    done = vectors.embed_texts(texts, cache, lambda: lambda chunk: [[3.0, 4.0]] * len(chunk))
    got = {r["text"]: r["embedding"] for r in done.collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] == pytest.approx([0.6, 0.8])
    merged = vectors.merge_cache(cache, spark.createDataFrame([("a", [9.0, 9.0])], TEXT_VECTORS))
    assert {r["text"]: r["embedding"][0] for r in merged.collect()} == {"a": 9.0, "b": 0.0}
    rows = vectors.lookup(spark.createDataFrame([("zzz",), ("b",)], "text string"), cache, 2).collect()
    assert {r["text"]: r["embedding"] for r in rows} == {"zzz": [0.0, 0.0], "b": [0.0, 1.0]}


def test_vector_cache_table(spark, tmp_path):
    path = str(tmp_path / "cache")
    encoder = lambda: lambda chunk: [[float(len(t)), 0.0] for t in chunk]
    first = spark.createDataFrame([("a",), ("bb",), (None,), ("",)], "text string")
    more = spark.createDataFrame([("bb",), ("ccc",)], "text string")
    assert vectors.read_cache(spark, path).count() == 0
    assert vectors.update_cache(path, first, encoder, normalize=False).count() == 2
    other = lambda: lambda chunk: [[-1.0, 0.0]] * len(chunk)
    got = {r["text"]: r["embedding"][0] for r in vectors.update_cache(path, more, other, normalize=False).collect()}
    assert got == {"a": 1.0, "bb": 2.0, "ccc": -1.0}


def test_vector_cache_reads_what_it_needs(spark, tmp_path):
    """Few texts: their folders only, by their keys. Overlapping batches: the last vector of a text counts, before and after compaction."""
    path = str(tmp_path / "cache")
    table = spark.range(2000).select(F.concat(F.lit("t"), "id").alias("text"), F.array(F.col("id").cast("float")).alias("embedding"))
    vectors.append_cache(path, table)
    vectors.append_cache(path, table.where("text IN ('t5', 't6')").withColumn("embedding", F.array(F.lit(-1.0).cast("float"))))
    few = spark.createDataFrame([("t5",), ("t7",), ("absent",)], "text string")
    assert {r["text"]: r["embedding"] for r in vectors.cached(path, few).collect()} == {"t5": [-1.0], "t7": [7.0]}
    plan = vectors.stored_rows(path, few)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan[plan.index("PartitionFilters") :].split("]")[0] and "In(key" in plan
    assert vectors.stored_rows(path, few).count() == 3  # both versions of one text, and another one
    assert vectors.read_cache(spark, path).count() == 2000
    untouched = {f: p.stat().st_mtime_ns for f in ("bucket=0",) for p in [Path(path, f)]}
    dirty = {r["bucket"] for r in vectors._keyed(spark.createDataFrame([("t5",), ("t6",)], "text string")).collect()}
    assert vectors.compact_cache(spark, path) == 2 and vectors.compact_cache(spark, path) == 0
    assert 0 in dirty or Path(path, "bucket=0").stat().st_mtime_ns == untouched["bucket=0"]
    got = {r["text"]: r["embedding"] for r in vectors.read_cache(spark, path).collect()}
    assert len(got) == 2000 and got["t6"] == [-1.0] and got["t1999"] == [1999.0]
    assert vectors._cache_files(spark, path).count() == 2000


def test_ragged_vectors_are_refused(spark):
    table = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], TEXT_VECTORS)
    with pytest.raises(ValueError, match="dimensions"):
        vectors.dimensions(table)


def test_vector_map_blocks(spark, news):
    texts = news.parsed.select(F.col("event_text_normalized").alias("text"))
    table = vectors.hashed_vectors(texts, 4)
    sessions = spark.createDataFrame([(0,), (77,)], "session long")
    got = vector_feature_map(news, table, sessions, dims=4).toPandas().set_index("session")
    assert (got.loc[77] == 0).all() and "text_cw_event_norm__weighted_emb_000" in got and "text_cw_event_norm__relevance_gap" in got
    full = VectorBlock("all", include_structured_features=True, include_sequence_features=True)
    wide = vector_feature_map(news, table, sessions, [full], dims=4)
    assert "all__w_verb__wins" in wide.columns and "all__polarity_flip_rate" in wide.columns
    with pytest.raises(ValueError):
        vector_feature_map(news, table, sessions, [full, full], dims=4)
    with pytest.raises(ValueError):
        vector_feature_map(news, table, sessions, [VectorBlock("p", include_price_interactions=True)], dims=4)
    with pytest.raises(ValueError):
        vector_feature_map(news, table, sessions, [VectorBlock("p", aggregation="nope")], dims=4)


def test_session_mean_vector_by_hand(news):
    table = vectors.hashed_vectors(news.parsed.select(F.col("event_text_normalized").alias("text")), 4)
    lookup = {r["text"]: r["embedding"] for r in table.collect()}
    got = vectors.session_vectors(news.parsed, table, "event_normalized", 4).toPandas().set_index("session")
    pdf = news.parsed.select("session", "event_text_normalized").toPandas()
    for session, g in pdf.groupby("session"):
        want = pd.DataFrame([lookup[t] for t in g["event_text_normalized"]]).mean().tolist()
        assert got.loc[session, [f"session_emb_{i:03d}" for i in range(4)]].tolist() == pytest.approx(want)


def test_able_terms_hold_the_whole_vocabulary(spark):
    """Counts of the able terms alone give the vocabulary of all counts, with repeated and null documents, and leave most terms out."""
    rng = np.random.default_rng(5)
    rows = [(int(i) if i % 17 else None, " ".join(f"w{int(w)}" for w in rng.zipf(1.3, 40) if w < 3000)) for i in rng.integers(0, 200, 300)]
    docs = spark.createDataFrame([*rows, (1, None), (2, "")], "doc_id long, text string")
    n_docs = spark.createDataFrame([(200,)], "n_docs long")
    whole = tfidf.term_counts(docs, ["doc_id"], 2, single_part=True)
    for min_df, features in ((1, 12), (2, 12), (2, 100_000), (3, 12)):
        able = tfidf.able_terms(docs, "doc_id", min_df, features)
        assert (able is None) == (features > 1000 or min_df > 2)
        counts = tfidf.term_counts(docs, ["doc_id"], 2, single_part=True, only=able)
        got, want = (tfidf.vocabulary(c, n_docs, min_df=min_df, max_features=features).toPandas().sort_values("position") for c in (counts, whole))
        assert got.reset_index(drop=True).equals(want.reset_index(drop=True))
        if able is not None:
            assert counts.select("term").distinct().count() < whole.select("term").distinct().count() / 10


def test_company_and_words_of_odd_blanks(spark):
    """Any blank parts words, however many; the shortest company whose remainder opens an event wins, whatever its case."""
    rows = [
        "\u2003Relbos\u00a0\u3000Reports  3.5% gains\x1f", "A b c D sees 7 %", "A b c d e sees x", "x", "x y", "x y z", "", None, " \x85 ", "\u0130x Wins  it",
        "Sees wins sees", "50%a wins $2B", "Reports",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "pos int, headline string")
    got = [(r["company"], r["body"], r["headline_normalized"], r["event_text_normalized"]) for r in parse_headlines(df).orderBy("pos").collect()]
    assert got == [
        ("Relbos", "Reports 3.5% gains", "relbos reports pct token gains", "reports pct token gains"),
        ("A b c D", "sees 7 %", "a b c d sees 7", "sees 7"),
        ("A b", "c d e sees x", "a b c d e sees x", "c d e sees x"),
        ("x", "", "x", ""),
        ("x", "y", "x y", "y"),
        ("x y", "z", "x y z", "z"),
        ("", "", "", ""),
        ("", "", "", ""),
        ("", "", "", ""),
        ("\u0130x", "Wins it", "i x wins it", "wins it"),
        ("Sees", "wins sees", "sees wins sees", "wins sees"),
        ("50%a", "wins $2B", "pct token a wins 2b", "wins 2b"),
        ("Reports", "", "reports", ""),
    ]


def test_the_grammar_is_code_that_the_jvm_compiles(spark, tmp_path, capsys):
    """Methods over 8,000 bytes stay interpreted: the word lists must not be spelled out in them."""
    spark.createDataFrame([(1, 1, "Acme wins x")], "session long, bar_ix int, headline string").write.parquet(str(tmp_path / "h"))
    parse_headlines(spark.read.parquet(str(tmp_path / "h"))).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_lists_take_the_first_entry_that_fits(spark):
    body = ["files for regulatory approval and faces class action", "to host x", "", "wins", None]
    for text, rule in zip(body, (1, None, 0, None, 0)):
        row = spark.createDataFrame([(text,)], "t string").select(
            rule_number(F.col("t")).alias("rule"), verb_family(F.col("t")).alias("verb"), longest_match(F.col("t"), ["AI", "wins a", "wins"]).alias("word")
        ).first()
        fits = [n for n, (_, _, _, parts) in enumerate(lexicon.EVENT_RULES, 1) if text and all(p in text for p in parts)]
        assert row["rule"] == min(fits, default=0) and (rule is None or row["rule"] == rule)
        assert row["verb"] == (None if text is None else "unknown" if not text else next((p.replace(" ", "_") for p in lexicon.VERB_PHRASES if text.startswith(p)), text.split(" ")[0]))
        assert row["word"] == ("wins" if text == "wins" else "none")


def test_aggregates_of_parsed_headlines_run_in_bounded_tasks(spark, monkeypatch):
    from tickloom import session

    rows = [(i % 3, i % 7, i, f"Relbos wins award {i}") for i in range(400)]
    news = News(spark.createDataFrame(rows, "session long, bar_ix int, pos long, headline string").coalesce(1))
    monkeypatch.setattr(session, "TASK_ROWS", 40)
    sizes = [r["count"] for r in news.spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and len(sizes) > 5 and max(sizes) < 120


@pytest.mark.parametrize("part", [None, 1])
def test_seams_of_documents_with_null_keys(spark, part):
    rows = [(None, 0, "a b"), (None, part, "c d"), (2, 0, "e f"), (2, 1, ""), (2, 2, "g"), (3, 0, "h i")]
    parts = spark.createDataFrame(rows, "session long, part long, text string")
    got = {(r["session"], r["term"]) for r in tfidf.term_counts(parts, ["session"], 2).collect() if "_" in r["term"]}
    assert got >= {(None, "a_b"), (None, "c_d"), (2, "e_f"), (2, "f_g"), (3, "h_i")}
    assert ((None, "b_c") in got) == (part == 1)
