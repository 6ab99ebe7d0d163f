"""Removal of benchmark text from documents: a hash set of normalised word windows, scanned, verified, and cut out.

All of it is SQL functions. Each document row hashes its own windows and keeps the positions whose hash the benchmark has; only
those few leave the row, with their words, and are joined to the benchmark's windows on the words themselves. The hash set is cut into slices of
the hash range, so that no plan or task holds more than a bounded part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import query, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SET_WINDOWS = 50_000  # hashes in one literal set; those of a larger benchmark are cut into slices, one set each
PASS_SETS = 4  # sets in one scan of the documents
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: str = "text") -> Column:
    """Lower-cased A-Z; words are runs of digits, a-z and all that is not ASCII."""
    return F.coalesce(F.array_remove(F.split(F.translate(F.col(text), UPPER, LOWER), GAP), ""), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(gram, len, h, items): distinct windows of all items; an item of fewer words is one window."""
    items = benchmark.select("item_id", normal_words().alias("w")).where(F.size("w") > 0)
    pieces = f"transform(sequence(1, greatest(size(w) - {width} + 1, 1)), i -> slice(w, i, least({width}, size(w))))"
    grams = items.select("item_id", F.explode(F.expr(pieces)).alias("p"))
    named = grams.select("item_id", F.array_join("p", " ").alias("gram"), F.size("p").alias("len"), F.xxhash64("p").alias("h"))
    return named.groupBy("gram", "len", "h").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, set_windows: int = SET_WINDOWS) -> DataFrame:
    """(doc_id, tag, n_words, spans, items) for every row of `docs` (doc_id, text; other columns are ignored).

    spans are the verified occurrences (pos from 1, len); items the ids, as text, of the items that occur. Null and empty texts have
    no words and no spans; items without words never occur; items with a null id count as null items and are left out of `items`.
    Rows with one id are kept apart by `tag`, a hash of the text; repeated rows come back as often as they came. An empty table of either kind gives no spans.
    """
    grams = benchmark_windows(benchmark, width)
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # at most `width` numbers
    sets = max(1, -(-grams.agg(F.count_distinct("h")).first()[0] // set_windows))
    words = docs.select("doc_id", F.xxhash64("text").alias("tag"), normal_words().alias("w"))
    rows = None
    for first in range(0, sets, PASS_SETS):
        hits = [F.array().cast("array<struct<pos:int,len:int,gram:string>>")]
        for part in range(first, min(first + PASS_SETS, sets)):
            known = ", ".join(str(r[0]) for r in grams.where(F.pmod("h", F.lit(sets)) == part).select("h").distinct().collect())  # about set_windows
            for n in lengths if known else []:
                places = f"if(size(w) >= {n}, sequence(1, size(w) - {n} + 1), cast(array() as array<int>))"
                places = f"filter({places}, i -> xxhash64(slice(w, i, {n})) IN ({known}))"
                hits.append(F.expr(f"transform({places}, i -> struct(i AS pos, {n} AS len, array_join(slice(w, i, {n}), ' ') AS gram))"))
        found = words.select("doc_id", "tag", F.size("w").cast("long").alias("n_words"), F.concat(*hits).alias("hits"))
        if rows is None:  # the first scan stands for the rows themselves
            rows = found.select("doc_id", "tag", "n_words", F.posexplode_outer("hits").alias("nth", "hit"))
        else:
            rows = rows.union(found.select("doc_id", "tag", "n_words", F.lit(1).alias("nth"), F.explode("hits").alias("hit")))
    rows = rows.select("doc_id", "tag", "n_words", "nth", "hit.*")
    right = grams.select("gram", "items")
    joined = rows.join(F.broadcast(right) if sets == 1 else right, "gram", "left")
    out = joined.groupBy("doc_id", "tag", "n_words").agg(
        F.sum(F.when(F.coalesce("nth", F.lit(0)) == 0, 1)).cast("int").alias("rows"),
        F.collect_set(F.when(F.col("items").isNotNull(), F.struct("pos", "len"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    again = F.explode(F.array_repeat(F.lit(1), F.col("rows"))).alias("__row")
    return out.select("doc_id", "tag", "n_words", F.array_sort("spans").alias("spans"), F.array_sort("items").alias("items"), again).drop("__row")


def covered(spans: str = "spans") -> Column:
    """Distinct word positions inside any span."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, remove: str = "documents") -> DataFrame:
    """`docs` without the documents that hold benchmark windows, or with the windows' words removed (remove="spans").

    A document with removed spans keeps its other words, normalised and joined by one space; the others keep their text. Null ids are matched
    with nulls, rows that share an id by their text; null and empty texts hold no window and stay. Either table may be empty.
    """
    found = leaks(docs, benchmark, width).where(F.size("spans") > 0).distinct()
    found = found.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__tag"))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    words, gone = normal_words(), covered("__spans")
    left = F.filter(F.transform(words, lambda w, i: F.when(~F.array_contains(gone, i + 1), w)), lambda w: w.isNotNull())
    cut = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join(left, " "))
    return docs.join(found, same, "left").withColumn("text", cut).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
h AS (SELECT x.doc_id, x.i, x.n, g.item_id FROM x JOIN g ON g.n = x.n AND array_to_string(x.w[x.i:x.i + x.n - 1], ' ') = g.gram),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op9_benchmark_decontamination", ORACLE)
def op9_benchmark_decontamination(spark, sf_dir):
    """Words of all documents that lie in ten-word windows of the benchmark's items."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size(covered()).cast("long")
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest, (n_hit > 0).alias("contaminated"))
