"""URL filters by a cascade of Bloom filters: exact membership for every key of the corpus, without a join.

The first level encodes the listed keys. All keys of the corpus are held against it; those that pass without being listed are its
false positives, and the second level encodes them. The third encodes the listed keys that pass the second, and so on, until no
key passes wrongly. A key then is listed exactly if the first level that it does not pass is an even one (or, passing all, if the
last is odd). Keys of a URL are all its pairs of host suffix and path prefix that a rule could have, longest first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import query, table
from tickloom.llm.words import mixed
from tickloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = "h1 long, h2 long"
SLICE_BYTES = 16_000_000  # a filter that would be larger is cut into slices of the key range, one pass over the URLs each
LATER_RATE = 0.05  # false positives of all levels but the first
MOST_LEVELS = 64


@dataclass(frozen=True)
class Level:
    """A Bloom filter: `probes` bits a key in `words`."""

    words: np.ndarray
    probes: int
    salt: int

    def bits(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Bit numbers, one row a probe."""
        h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64) | np.uint64(1)
        with np.errstate(over="ignore"):
            turns = np.arange(self.probes, dtype=np.uint64)[:, None] + np.uint64(self.salt * 1000)
            return mixed(h1 + turns * h2) % np.uint64(64 * len(self.words))

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits = self.bits(h1, h2)
        return ((self.words[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1)).all(axis=0)


def contains(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key of the corpus is listed."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    open_ = np.arange(len(h1))
    for i, level in enumerate(levels):
        ok = level.passes(h1[open_], h2[open_])
        out[open_[~ok]] = i % 2 == 1
        open_ = open_[ok]
    return out


def sized(n: int, rate: float) -> tuple[int, int]:
    """64-bit words and probes of a filter of n keys."""
    bits = max(64, int(np.ceil(n * -np.log(rate) / np.log(2) ** 2)))
    return -(-bits // 64), max(1, round(-np.log2(rate)))


def encode(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """The filter of the n rows of `keys` (h1, h2): bits are set in tasks, words are combined by Spark."""
    words, probes = sized(n, rate)
    blank = Level(np.zeros(words, np.uint64), probes, salt)

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(blank.bits(np.asarray(batch.column("h1")), np.asarray(batch.column("h2"))))
            word = bits >> np.uint64(6)
            heads = np.flatnonzero(np.diff(word.astype(np.int64), prepend=-1))
            if len(heads):
                value = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), heads)
                yield pa.RecordBatch.from_arrays([pa.array(word[heads].astype(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

    set_words = keys.select("h1", "h2").mapInArrow(bits_of, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    found = set_words.toArrow()  # at most the filter itself, whose size the caller has bounded
    full = np.zeros(words, np.uint64)
    full[np.asarray(found["word"])] = np.asarray(found["value"]).view(np.uint64)
    return Level(full, probes, salt)


def passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.passes(np.asarray(batch.column("h1")), np.asarray(batch.column("h2")))))

    return keys.select("h1", "h2").mapInArrow(probe, KEY)


def build(listed: DataFrame, universe: DataFrame, slice_bytes: int = SLICE_BYTES, first_rate: float | None = None) -> list[list[Level]]:
    """One cascade for each slice of the key range, exact for every key of `universe` and `listed` (h1, h2; two hashes of a key).

    `universe` may repeat keys and hold listed ones. The first level's rate follows the sizes of both, so that its false positives are
    about as many as the listed keys: all levels together grow with the list, and with the corpus only by its logarithm.
    """
    listed = materialize(listed.distinct(), "listed")
    many, keys = listed.count(), universe.agg(F.approx_count_distinct("h1")).first()[0]
    rate = first_rate or min(0.5, max(1e-9, many / max(1, keys)))
    slices = max(1, -(-8 * sized(many, rate)[0] // slice_bytes))
    out = []
    for s in range(slices):
        mine = F.pmod("h1", F.lit(slices)) == s
        yes, n = listed.where(mine), listed.where(mine).count() if slices > 1 else many
        levels = [encode(yes, n, rate, 0)]
        # false positives: keys of the corpus that pass and are not listed; told apart by grouping, as both are few
        wrong = passing(universe.where(mine) if slices > 1 else universe, levels[0]).select("h1", "h2", F.lit(0).alias("l"))
        wrong = wrong.union(yes.select("h1", "h2", F.lit(1).alias("l"))).groupBy("h1", "h2").agg(F.max("l").alias("l"))
        wrong, inside = materialize(wrong.where("l = 0").select("h1", "h2"), "wrong"), yes
        while n := wrong.count():
            if len(levels) == MOST_LEVELS:
                raise ValueError("two keys share both hashes")
            levels.append(encode(wrong, n, LATER_RATE, len(levels)))
            wrong, inside = materialize(passing(inside, levels[-1]), "wrong"), wrong
        out.append(levels)
    return out


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidates(host_sizes: Sequence[int], path_sizes: Sequence[int]) -> Column:
    """Pairs of host suffix and path prefix of the row's (host, path) with lengths that rules have, longest first."""
    sizes = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    n = F.length("host")
    fits = lambda k: (n == k) | ((n > k) & (F.substring("host", n - k, F.lit(1)) == "."))
    hosts = F.filter(sizes(host_sizes), fits)
    paths = F.filter(sizes(path_sizes), lambda k: k <= F.length("path"))
    shapes = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct((-h - p).alias("least"), (-h).alias("h"), p.alias("p")))))
    tail = lambda k: F.substring("host", n + k + 1, -k)
    return F.transform(F.array_sort(shapes), lambda s: F.struct(tail(s["h"]).alias("host"), F.substring("path", F.lit(1), s["p"]).alias("path")))


def hashes(host: Column, path: Column) -> tuple[Column, Column]:
    return F.xxhash64(host, path).alias("h1"), F.xxhash64(F.lit("second"), host, path).alias("h2")


def _listed(cascades: list[list[Level]], s: int, spark) -> object:
    """An Arrow function: for the key arrays of a row, which of them slice `s` lists."""
    shared, slices = spark.sparkContext.broadcast(cascades[s]), len(cascades)

    @F.arrow_udf("array<boolean>")
    def held(h1: pa.Array, h2: pa.Array) -> pa.Array:
        first, second = np.asarray(h1.flatten()), np.asarray(h2.flatten())
        mine = np.flatnonzero(first % slices == s)
        out = np.zeros(len(first), bool)
        out[mine] = contains(shared.value, first[mine], second[mine])
        return pa.ListArray.from_arrays(pa.array(np.asarray(h1.offsets) - h1.offsets[0].as_py(), pa.int32()), pa.array(out))

    return held


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages` (page_id, url) under `rules` (host, path, verdict allow or block).

    Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end; both
    empty for a null URL or one without `://`. A rule fits its host and all subdomains where the path starts with its own. Of several the
    longest (host and path together, then host) decides; `rule` is its host and path joined. Where none fits, rule is null and the verdict `default`: a URL
    that is not listed. Rules with a null are left out; of rules alike, block holds. Null ids stay, repeated rows come back as often as
    they came, other columns are ignored, empty tables give no rows or no rules. Membership is exact for all URLs given. The filters grow with
    the rules; beyond `slice_bytes` they are used in slices, one pass each, so that no task holds more.
    """
    spark = pages.sparkSession
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')")
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", (F.col("verdict") == "block").alias("block"))
    rules = materialize(rules.groupBy("host", "path").agg(F.max("block").alias("block")), "rules")
    sizes = rules.agg(*[F.sort_array(F.collect_set(F.length(c))) for c in ("host", "path")]).first()  # distinct lengths only
    host, path = url_parts()
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", candidates(*sizes))
    keyed = rows.select(F.explode("keys").alias("k")).select(*hashes(F.col("k.host"), F.col("k.path")))
    known = rules.select("block", *hashes(F.col("host"), F.col("path")))
    listed = build(known.select("h1", "h2"), keyed, slice_bytes)
    blocked = build(known.where("block").select("h1", "h2"), known.where("NOT block").select("h1", "h2"), slice_bytes)
    for name, cascades in (("listed", listed), ("blocked", blocked)):
        column = None
        for s in range(len(cascades)):
            if column is not None:  # one slice in memory at a time
                rows = materialize(rows, "judged")
            first, second = F.transform("keys", lambda k: hashes(k["host"], k["path"])[0]), F.transform("keys", lambda k: hashes(k["host"], k["path"])[1])
            held = _listed(cascades, s, spark)(first, second)
            column = held if column is None else F.zip_with(name, held, lambda a, b: a | b)
            rows = rows.withColumn(name, column)
    at = F.array_position("listed", F.lit(True)).cast("int")
    rule = F.when(at > 0, F.element_at("keys", at))
    verdict = F.when(at > 0, F.when(F.element_at("blocked", at), "block").otherwise("allow")).otherwise(default)
    return rows.select("page_id", "host", "path", F.concat(rule["host"], rule["path"]).alias("rule"), verdict.alias("verdict"))


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

ORACLE = f"""
WITH r(rule_host, rule_path, verdict) AS (VALUES {', '.join(str(r) for r in RULES)}),
u AS (SELECT row_number() OVER () AS nth, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT nth, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT nth, arg_max(rule_host || rule_path, length(rule_host || rule_path) * 1000 + length(rule_host)) AS rule,
        arg_max(verdict, length(rule_host || rule_path) * 1000 + length(rule_host)) AS verdict
      FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY nth)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (nth)
"""


@query("op12_url_filters", ORACLE)
def op12_url_filters(spark, sf_dir):
    """Verdicts for the URLs of all pages."""
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
