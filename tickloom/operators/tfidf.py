"""TF-IDF over documents given as parts, all in long form.

Terms are n-grams of lower-case alphanumeric tokens. Counting is a map-side-combined aggregate over
(document, term). N-grams that cross from one part into the next are counted from the parts' edge tokens.
`scope` names extra key columns (a fold, a company slot) that each have their own vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.numeric import ratio
from tickloom.functions.text import alnum_tokens
from tickloom.session import materialize

# A vocabulary of at most this many rows (a few tens of bytes each) may be broadcast.
BROADCAST_ROWS = 200_000
TERM_BUCKETS = 256


def _spans(tokens: Column, starts: Column, n: int) -> Column:
    """The n tokens from each start, joined by an underscore."""
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), "_"))


def ngrams(tokens: Column, ngram_max: int) -> Column:
    """All 1..n-grams of a token array, joined by an underscore."""
    grams = [tokens]
    for n in range(2, ngram_max + 1):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        grams.append(_spans(tokens, starts, n))
    return F.concat(*grams)


def _edge_ngrams(parts: DataFrame, keys: Sequence[str], ngram_max: int) -> DataFrame:
    """N-grams spanning the seam before a part, from edge tokens only."""
    m = ngram_max - 1
    size = F.size("tokens")
    edges = parts.select(
        *keys,
        "part",
        F.slice("tokens", 1, m).alias("head"),
        F.slice("tokens", F.greatest(size - m + 1, F.lit(1)), F.lit(m)).alias("tail"),
    )
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(-m, -1)
    carried = edges.withColumn("carry", F.flatten(F.collect_list("tail").over(before)))
    carried = carried.where(F.size("carry") > 0).withColumn(
        "carry", F.slice("carry", F.greatest(F.size("carry") - m + 1, F.lit(1)), F.lit(m))
    )
    joined, cut = F.concat("carry", "head"), F.size("carry")
    spans = []
    for n in range(2, ngram_max + 1):
        # A span of n tokens crosses the seam when it starts at or before the cut and ends after it.
        first = F.greatest(cut - (n - 2), F.lit(1))
        last = F.least(cut, F.size(joined) - (n - 1))
        starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        spans.append(_spans(joined, starts, n))
    return carried.select(*keys, F.explode(F.concat(*spans)).alias("term"))


def able_terms(docs: DataFrame, key: str, min_df: int, max_features: int) -> DataFrame | None:
    """The 1- and 2-grams (term) of whole documents (key, text) that can be in a vocabulary cut by (-tf, -df, term); None if all can.

    The max_features most frequent words with min_df documents bound the last term of the vocabulary from below, and a pair of words is no more
    frequent than either. So words and pairs under that bound are left out before any count per document. Tasks send one count a term.
    """
    if min_df > 2 or max_features <= 0:
        return None
    tokens = docs.select(key, alnum_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    words = tokens.select(key, F.explode("tokens").alias("term")).groupBy("term")
    words = materialize(words.agg(F.count(F.lit(1)).alias("tf"), F.min(key).alias("low"), F.max(key).alias("high")), "words")
    sure = words.where(F.col("low") < F.col("high")) if min_df == 2 else words
    best = sure.orderBy(F.col("tf").desc()).limit(max_features).agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("least")).first()
    if best["n"] < max_features:
        return None
    able = words.where(F.col("tf") >= best["least"]).select("term")
    word = F.broadcast(able) if able.count() <= BROADCAST_ROWS else able
    many = F.size("tokens") - 1
    pairs = tokens.where(F.size("tokens") > 1).select(
        F.explode(F.arrays_zip(F.slice("tokens", F.lit(1), many).alias("a"), F.slice("tokens", F.lit(2), many).alias("b"))).alias("p")
    )
    pairs = pairs.select("p.*")
    for side in ("a", "b"):
        pairs = pairs.join(word.withColumnRenamed("term", side), side, "left_semi")
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("tf")).where(F.col("tf") >= best["least"])
    return materialize(able.unionByName(pairs.select(F.concat_ws("_", "a", "b").alias("term"))), "able-terms")


def term_counts(
    parts: DataFrame, keys: Sequence[str], ngram_max: int = 2, single_part: bool = False, only: DataFrame | None = None
) -> DataFrame:
    """(keys, term, n): term counts of every document. Documents without tokens have no rows.

    `single_part` skips the seam step for tables known to hold one part per document. `only` (term) names the terms to count, all if None.
    """
    keys = list(keys)
    tokenized = parts.select(
        *keys, *([] if single_part else ["part"]), alnum_tokens(F.coalesce("text", F.lit(""))).alias("tokens")
    )
    terms = tokenized.select(*keys, F.explode(ngrams(F.col("tokens"), ngram_max)).alias("term"))
    if ngram_max > 1 and not single_part:
        # Only documents of several parts have seams; the others' texts are not tokenized again.
        several = parts.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__parts")).where("__parts > 1")
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        terms = terms.unionByName(_edge_ngrams(tokenized.where(F.size("tokens") > 0).join(several, same, "left_semi"), keys, ngram_max))
    if only is not None:
        terms = terms.join(F.broadcast(only) if only.count() <= BROADCAST_ROWS else only, "term", "left_semi")
    return terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + 1.0


def cut_vocabulary(stats: DataFrame, scope: Sequence[str], min_df: int, max_features: int) -> DataFrame:
    """Terms (scope, term, df, tf) with df >= min_df, numbered by (-tf, -df, term) up to max_features.

    The cut is made twice: in each of TERM_BUCKETS hash buckets of the terms, whose best max_features pass, and over what passed. So a
    scope's vocabulary of any size is never sorted in one task. max_features <= 0 keeps all terms, unnumbered.
    """
    kept = stats.where(F.col("df") >= min_df)
    if max_features <= 0:
        return kept.withColumn("position", F.lit(None).cast("int"))
    best = [F.col("tf").desc(), F.col("df").desc(), F.col("term")]
    bucket = F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int")
    spread = kept.withColumn("__bucket", bucket)
    first = F.row_number().over(Window.partitionBy(*scope, "__bucket").orderBy(*best))
    passed = spread.withColumn("position", first).where(F.col("position") <= max_features).drop("__bucket")
    last = F.row_number().over(Window.partitionBy(*(scope or [F.lit(0)])).orderBy(*best))
    return passed.withColumn("position", last).where(F.col("position") <= max_features)


def vocabulary(
    counts: DataFrame, n_docs: DataFrame, scope: Sequence[str] = (), min_df: int = 2, max_features: int = 256
) -> DataFrame:
    """(scope, term, df, tf, position, idf). `n_docs` (scope, n_docs) counts all documents, empty ones too."""
    stats = counts.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))
    cut = cut_vocabulary(stats, scope, min_df, max_features)
    # One row per scope: a handful of rows.
    joined = cut.join(F.broadcast(n_docs), list(scope)) if scope else cut.crossJoin(F.broadcast(n_docs))
    return joined.withColumn("idf", idf(F.col("n_docs"), F.col("df"))).drop("n_docs")


def tfidf(
    counts: DataFrame, vocab: DataFrame, keys: Sequence[str], scope: Sequence[str] = (), vocab_rows: int | None = None
) -> DataFrame:
    """(keys, scope, term, position, weight): in-vocabulary share times idf, each document scaled to unit length.

    The in-vocabulary total cancels, so weight = n*idf / sqrt(sum((n*idf)^2)). `vocab_rows` is the vocabulary's row bound (features times
    scopes) where it is known: up to BROADCAST_ROWS it is broadcast, so a frequent term never
    skews a join; otherwise the join is left to Spark.
    """
    on = ["term", *[s for s in scope if s in counts.columns]]
    lookup = vocab.select(*dict.fromkeys([*scope, "term"]), "position", "idf")
    bounded = vocab_rows is not None and 0 < vocab_rows <= BROADCAST_ROWS
    if bounded:
        lookup = F.broadcast(lookup)
    hits = counts.join(lookup, on).withColumn("x", F.col("n") * F.col("idf"))
    doc = list(dict.fromkeys([*keys, *scope]))
    square = F.col("x") * F.col("x")
    if bounded:
        # A document has at most one row per vocabulary term, so its window is small.
        normed = hits.withColumn("norm", F.sqrt(F.sum(square).over(Window.partitionBy(*doc))))
    else:
        normed = hits.join(hits.groupBy(*doc).agg(F.sqrt(F.sum(square)).alias("norm")), doc)
    weight = F.coalesce(ratio(F.col("x"), F.col("norm")), F.lit(0.0))
    return normed.select(*doc, "term", "position", weight.alias("weight"))
