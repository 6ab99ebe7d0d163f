"""Whitening, URL filters and ranked search against brute force on small and awkward tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import edge_docs, empty_docs, random_docs
from tickloom.llm import ranked_search, registry, url_filter, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, x string, whitened string, component string, n string"


# ---- whitening


def brute_whitening(vectors, components=8):
    """(n, deviations by row, whitened by row up to sign, explained) from plain integers and numpy."""
    good = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = Counter(len(v) for _, v in good)
    dims = max(lengths, key=lambda size: (lengths[size], size))
    rows = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in good if len(v) == dims]
    n, sums = len(rows), [sum(c) for c in zip(*(x for _, x in rows))]
    away = [[n * c - s for c, s in zip(x, sums)] for _, x in rows]
    cross = [[sum(a[i] * a[j] for a in away) for j in range(dims)] for i in range(dims)]
    covariance = np.array([[c / n**3 for c in r] for r in cross])
    values, basis = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    white = (np.array(away, float) / n) @ basis[:, order] / np.sqrt(values[order])
    return rows, [sum(a * a for a in r) for r in away], white, values[order] / np.trace(covariance)


def float32(v):
    return None if v is None else [None if c is None else float(np.float32(c)) for c in v]


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.3 + rng.normal(size=12)
    mixed[5] *= 4000.0
    vectors = [(i, float32(v.tolist())) for i, v in enumerate(mixed)] + [(7, float32(mixed[7].tolist())), (None, float32(mixed[8].tolist()))]
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] + [0.0] * 11), (904, [float("inf")] * 12), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in vectors + odd], VECTORS).repartition(5)
    got = whitening.whiten(df).collect()
    rows, deviation, white, explained = brute_whitening(vectors)
    assert len(got) == 8 * len(rows) == 8 * 302
    assert {r.n for r in got} == {302} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    want = Counter((i, d if d < 2**63 else None) for (i, _), d in zip(rows, deviation))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == want
    for c in range(8):
        mine = sorted((r.vec_id if r.vec_id is not None else -1, r.whitened, r.explained) for r in got if r.component == c + 1)
        theirs = sorted((i if i is not None else -1, w) for (i, _), w in zip(rows, white[:, c]))
        a, b = np.array([m[1] for m in mine]), np.array([t[1] for t in theirs])
        sign = np.sign(a[np.abs(b).argmax()] * b[np.abs(b).argmax()])
        order_a = np.lexsort((a, [m[0] for m in mine]))
        order_b = np.lexsort((sign * b, [t[0] for t in theirs]))
        assert np.allclose(a[order_a], (sign * b)[order_b], atol=1e-7)
        assert math.isclose(mine[0][2], explained[c], rel_tol=1e-9)


def test_whitening_without_variance_and_beyond_64_bits(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(3)], "vec_id long, embedding array<float>")
    got = whitening.whiten(same).collect()
    assert len(got) == 9 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in got)
    one = whitening.whiten(same.limit(1)).collect()
    assert len(one) == 3 and all(r.whitened is None and r.n == 1 for r in one)
    far = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1e30, 0.5]), (2, [-1e30, 0.25])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whitening.whiten(far).collect() if r.component == 1}
    assert got[1].deviation is None and abs(got[1].whitened) == pytest.approx(math.sqrt(1.5)) and got[0].identity_error < 1e-4
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and got[0].identity_error < 1e-9


def test_whitening_of_empty_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    none = whitening.whiten(spark.createDataFrame([(1, None, "", "", "", ""), (2, [], "", "", "", "")], VECTORS))
    assert none.count() == 0
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_bit_planes_give_cross_products():
    rng = np.random.default_rng(1)
    u = rng.integers(0, [1, 2, 900, 2**40], (130, 4))
    bits = np.array([int(v).bit_length() for v in u.max(axis=0)])
    counts = np.zeros((4, 4, 2 * bits.max()), np.int64)
    whitening.add_cross_counts(counts, whitening.bit_planes(u, bits), bits)
    for i in range(4):
        for j in range(i, 4):
            assert sum(int(n) << s for s, n in enumerate(counts[i, j])) == sum(int(a) * int(b) for a, b in zip(u[:, i], u[:, j]))


def test_whitening_query(spark):
    got = registry.queries()["op11_embedding_whitening"](spark, SF).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows, deviation, white, _ = brute_whitening(vectors)
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter({(i, d): 8 for (i, _), d in zip(rows, deviation)})
    by = {(r.vec_id, r.component): r.whitened for r in got}
    for (i, _), w in zip(rows, white):
        assert np.allclose([abs(by[i, c + 1]) for c in range(8)], np.abs(w), atol=1e-8)


# ---- URL filters


def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], "block" if best[2] else "allow"


def random_urls(seed, n):
    rng = random.Random(seed)
    names = ["a", "bb", "c", "example", "net", "com", "www", "É", ""]
    out = []
    for _ in range(n):
        host = ".".join(rng.choice(names) for _ in range(rng.randrange(1, 5)))
        path = "".join(rng.choice(["/", "/en/", "/a", "b", "/es/x", ""]) for _ in range(rng.randrange(4)))
        path = path if not path or path[0] == "/" else "/" + path
        out.append(rng.choice(["http://", "HTTPS://", "x:", "://"]) + rng.choice([host, host.upper()]) + path + rng.choice(["", "?q=/en/", "#f", "?a://b"]))
    return out


AWKWARD = [None, "", "://", "http://", "http://com", "http://com/", "http://xcom/", "a://b://c/en/", "http://EXAMPLE.com/en/", "http://.com/", "http://com./", "http://net/es/" + "x" * 30_000, "http://" + "a." * 5_000 + "com/en/", "http://\n.com/é/"]


@pytest.mark.parametrize("slice_bytes", [16_000_000, 3])
def test_verdicts_equal_brute_force(spark, slice_bytes):
    rng = random.Random(5)
    urls = random_urls(4, 400) + AWKWARD * 2
    hosts = ["com", "net", "example.com", "a.net", "bb", "www.example.com", "a.bb.c"]
    rules = list({(rng.choice(hosts), rng.choice(["/", "/en/", "/a", "/es/", "", "/en/a"])): rng.choice(["allow", "block"]) for _ in range(25)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, host string, keys string, rule string")
    odd = [(None, "/", "block"), ("com", None, "block"), ("com", "/", None), ("com", "/", "neither")]
    got = url_filter.judge(pages, spark.createDataFrame(rules + rules[:3] + odd, "host string, path string, verdict string"), slice_bytes=slice_bytes).collect()
    want = Counter((i if i % 50 else None, *brute_verdict(u, rules)) for i, u in enumerate(urls))
    assert Counter(tuple(r) for r in got) == want


def test_no_rules_no_pages_and_rules_alike(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("COM", "/", "block")], "host string, path string, verdict string")
    assert {tuple(r) for r in url_filter.judge(pages, rules).collect()} == {(1, "a.com", "/x", "com/", "block"), (None, "", "", None, "allow")}
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    hashed = lambda lo, hi: spark.range(lo, hi).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"))
    listed, universe = hashed(0, 3000), hashed(1000, 40_000)
    for options in ({"first_rate": 0.5}, {}, {"slice_bytes": 500}):
        cascades = url_filter.build(listed, universe.union(universe), **options)
        keys = spark.range(0, 40_000).select("id", F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2")).toArrow()
        ids, h1, h2 = (np.asarray(keys[c]) for c in ("id", "h1", "h2"))
        found = np.zeros(len(ids), bool)
        for s, levels in enumerate(cascades):
            mine = h1 % len(cascades) == s
            found[mine] = url_filter.contains(levels, h1[mine], h2[mine])
        assert (found == (ids < 3000)).all()
        assert all(len(levels) > 1 for levels in cascades) and (len(cascades) > 1) == ("slice_bytes" in options)
        size = sum(8 * len(level.words) for levels in cascades for level in levels)
        assert "first_rate" in options or size < 3000 * 4  # grows with the list


# ---- ranked search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def bag(text):
    return Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def brute_ranks(docs, items, k):
    bags = [(d, bag(t)) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total, count = sum(sum(b.values()) for _, b in bags), len(bags)
    held = Counter(w for _, b in bags for w in b)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(bag(t))
    out = Counter()
    for i, ws in wanted.items():
        scores = []
        for d, b in bags:
            m = 50 + (50 * sum(b.values()) * count) // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * held[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 20 * m)) for w in ws if w in b)
            if s > 0:
                scores.append((-s, d is None, d))
        for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]):
            out[i, r + 1, d, -s] += 1
    return out


def zipf_docs(seed, n, vocabulary):
    rng = random.Random(seed)
    word = lambda: f"W{min(int(rng.paretovariate(0.7)), vocabulary)}"
    return [(i * 17 % n, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("k, block_terms", [(5, 10**6), (50, 40)])
def test_ranks_equal_brute_force(spark, k, block_terms):
    docs = zipf_docs(2, 700, 300) + random_docs(3, 60, 20)
    docs += [(None, docs[0][1]), (3, docs[0][1]), (9001, None), (9002, "?!"), (9003, "")]
    items = [(i, t) for i, t in zipf_docs(9, 12, 400)] + [(100, None), (101, "..."), (102, "unknown words"), (103, "w1 w1 W1"), (103, "w2"), (None, "w5 w6")]
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in docs], "doc_id long, text string, terms string, n string").repartition(3)
    got = ranked_search.search(df, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"), k, block_terms)
    assert Counter(tuple(r) for r in got.collect()) == brute_ranks(docs, items, k)


def test_search_edges(spark):
    docs = edge_docs(spark)
    items = docs.select(F.col("doc_id").alias("item_id"), "text", "source")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in ranked_search.search(docs, items, 4).collect()) == brute_ranks(pairs, pairs, 4)
    assert ranked_search.search(empty_docs(spark), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0


def test_windows_and_short_lists(monkeypatch):
    monkeypatch.setattr(ranked_search, "WINDOW", 16)
    rng = np.random.default_rng(8)
    docs, size = 400, 40
    held = [np.flatnonzero(rng.random(docs) < p) for p in np.geomspace(0.003, 0.9, size)]
    tf = rng.integers(1, 6, (docs, size))
    lists = [[t for t in range(size) if d in set(held[t].tolist())] for d in range(docs)]
    n = np.array([10 + len(x) for x in lists])
    weights = np.array([int(1000 * math.log((2 * docs + 2) / (2 * len(h) + 1))) for h in held])
    batch = pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(rng.permutation(docs)),
            "n": pa.array(n),
            "terms": pa.array(lists, pa.list_(pa.int32())),
            "tfs": pa.array([[int(tf[d, t]) for t in x] for d, x in enumerate(lists)], pa.list_(pa.int32())),
        }
    )
    ids = batch.column("doc_id").to_pylist()
    for q in range(30):
        wanted = np.sort(rng.choice(size, rng.integers(1, 20), replace=False))
        scores = []
        for d in range(docs):
            m = 50 + (50 * int(n[d]) * docs) // int(n.sum())
            s = sum(int(weights[t]) * ((10**9 * int(tf[d, t])) // (1000 * int(tf[d, t]) + 20 * m)) for t in wanted if t in lists[d])
            if s:
                scores.append((-s, ids[d]))
        best = ranked_search.Best(7)
        for half in (batch.slice(0, 250), batch.slice(250)):  # the bar of the first holds in the second
            ranked_search.Stretch(half, weights, docs, int(n.sum())).search(wanted, best)
        assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == sorted(scores)[:7]


def test_vocabulary_tells_terms_with_one_name_apart():
    vocabulary = ranked_search.Vocabulary.of(["ab", "cd", "é9"])
    clash = ranked_search.Vocabulary(np.repeat(vocabulary.names[:1], 3), vocabulary.data, vocabulary.edge, vocabulary.number)
    words = ranked_search.terms_of(pa.array(["AB-cd", None, "é9 ab", ""]))
    at, number = vocabulary.places(words)
    assert sorted(zip(at.tolist(), number.tolist())) == [(0, 0), (1, 1), (2, 2), (3, 0)]
    one = words.names == vocabulary.names[0]
    at, number = clash.places(words)
    assert sorted(at.tolist()) == np.flatnonzero(one).tolist() and {words.data[words.start[i] : words.end[i]].tobytes().decode() for i in at} == {["ab", "cd", "é9"][number[0]]}
