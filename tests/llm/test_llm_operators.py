"""Operators against brute force on small and awkward tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import edge_docs, empty_docs, random_docs
from tickloom.llm import blocks, crf, decontaminate, language_id, lm_score, mixing, ngram_join, sharding, substring_dedup, token_counts, topk, toxicity
from tickloom.llm import words as words_module
from tickloom.llm.prefix import hash_key, sums_before
from tickloom.llm.words import mixed, window_names, window_starts, words_of

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in BLANK.split(text or "") if w]


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def edge(spark):
    return edge_docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return empty_docs(spark)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- words


def test_words_follow_the_blank_class():
    texts = ["a b c\x0bd", None, "", " x ", "été\x1cz\n", "q" * 3000]
    words = words_of(pa.chunked_array([texts[:2], texts[2:]], pa.string()))
    assert [[w.decode() for w in words.bytes_of(i)] for i in range(len(texts))] == [split(t) for t in texts]
    assert words.counts.tolist() == [len(split(t)) for t in texts]
    names = words_of(pa.array(["u v u", "w u"])).names
    assert names[0] == names[2] == names[4] and len(set(names.tolist())) == 3


# ---- substring removal


def brute_repeats(rows, width):
    first = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            d_ = math.inf if d is None else d
            first[g] = min(first.get(g, math.inf), d_)
    out = []
    for d, t in rows:
        w, gone = split(t), set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (math.inf if d is None else d):
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("seed, vocabulary, width", [(1, 2, 5), (2, 3, 13), (3, 40, 13), (4, 6, 4)])
def test_remove_repeats_equals_brute_force(spark, seed, vocabulary, width):
    rows = random_docs(seed, 120, vocabulary)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows, width)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_remove_repeats_edges(edge, empty):
    got = substring_dedup.remove_repeats(edge).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(pairs_of(edge), 13)
    assert substring_dedup.remove_repeats(empty).count() == 0


# ---- similarity join


def brute_components(rows, width=5, percent=75):
    sets = []
    for d, t in rows:
        w = split(fold(t))
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
            continue
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), math.inf), d)
    return Counter((d, len(s), None if d is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies(seed, n):
    rng = random.Random(seed)
    bases = [[f"b{k}w{i}" for i in range(rng.randrange(4, 150))] for k in range(6)]
    passage = [f"p{i}" for i in range(30)]
    out = []
    for i in range(n):
        words = list(bases[min(rng.randrange(9), 5)])
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        if rng.random() < 0.2:
            words += passage
        out.append((i * 7 % n, " ".join(words)))
    return out


@pytest.mark.parametrize("rows", [near_copies(1, 240), near_copies(2, 90), random_docs(5, 150, 3, 30)], ids=["hot", "few", "dense"])
def test_components_equal_brute_force(spark, rows):
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_components_with_small_fragments(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SEGMENT_KEYS", 20)
    rows = near_copies(3, 80)
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_components_edges(edge, empty):
    got = ngram_join.similarity_components(edge).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(pairs_of(edge))
    assert ngram_join.similarity_components(empty).count() == 0


# ---- top k


def brute_topk(rows, queries, k):
    out = []
    for q, qv in queries:
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return Counter(out)


@pytest.mark.parametrize("dense", [True, False])
def test_topk_equals_brute_force(spark, dense):
    rng = random.Random(7)
    value = (lambda: rng.randrange(-4, 5)) if dense else (lambda: rng.choice([0] * 9 + [-3, 1, 2, 50]))
    rows = [(i, [value() for _ in range(12)]) for i in rng.sample(range(1000), 150)]
    vectors = spark.createDataFrame([(i, [x / 1024 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    index = topk.postings(vectors)
    got = topk.search(index, index.where("id % 5 = 0"), k=7, shard_rows=40, block_queries=8).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_topk(rows, [r for r in rows if r[0] % 5 == 0], 7)


def test_topk_edges(spark):
    rows = [(0, [0.5, -0.25]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, []), (6, [0.0, 0.0]), (6, [1.0, 1.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame([r + ("x", "y") for r in rows], "vec_id long, embedding array<double>, id string, weights string")
    index = topk.postings(vectors)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(index, index.where("id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 6, 512 * 1024 - 256 * 1024), (0, 2, 5, 0), (0, 3, 6, 0)]
    assert topk.search(index.limit(0), index.limit(0)).count() == 0
    assert topk.search(index, index.limit(0)).count() == 0


# ---- mixing


def brute_targets(sizes, weights, factor, epochs):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = factor * sum(sizes.values()), set(names), {s: 0.0 for s in names}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > epochs * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total if sizes[s] else 0.0 for s in open_}
        for s in full:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def test_mix_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(0, 90)), rng.choice(["a"] * 9 + ["b", "c", "é", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, seed="s").collect()
    sizes, size = defaultdict(int), {}
    for i, t, s in rows:
        size[i] = len(split(t))
        sizes[s] += size[i]
    target = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs, seed="s").collect()))
    drawn = mixing.draw(docs, mixing.mix(docs, seed="s")).collect()
    words = defaultdict(int)
    for r in drawn:
        words[r.doc_id] += len(split(r.text))
    assert all(words[r.doc_id] == r.taken for r in got)


def test_mix_edges(edge, empty):
    got = mixing.mix(edge).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(split(t))) for d, t in pairs_of(edge))
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and own[0].source_size == sum(r.size for r in own)
    drawn = mixing.draw(edge, mixing.mix(edge))
    assert drawn.columns == edge.columns
    assert sum(len(split(r.text)) for r in drawn.collect()) == sum(r.taken for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.draw(empty, mixing.mix(empty)).count() == 0


def test_sums_before_with_one_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", i % 11) for i in range(30_000)]
    df = spark.createDataFrame(rows, "id long, g string, v long").withColumn("k", hash_key(F.col("id").cast("string")))
    got = sums_before(df, ["g"], "k", ["id"], "v", "s", 30_000).collect()
    seen = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.k, r.id)):
        assert r.s == seen[r.g]
        seen[r.g] += r.v
    assert len(got) == 30_000


# ---- decontamination


def test_draw_keeps_the_budgets_of_sources_that_share_rows(spark):
    """One id and text in several sources, null among them: each source draws the words that it was given, whatever the order of the rows."""
    rows = [(1, "one two three four five six seven", s) for s in ("a", "b", None)] + [(d, "w " * d, s) for d in range(2, 9) for s in ("a", "b", None)]
    for order in (rows, rows[::-1], rows + rows[:4]):
        for seed in ("mix", "other"):
            docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
            mixed = mixing.mix(docs, seed=seed)
            want = Counter()
            for r in mixed.collect():
                want[r.source] += r.taken
            got = Counter()
            for r in mixing.draw(docs, mixed).collect():
                got[r.source] += len(split(r.text))
            assert got == want


def brute_leaks(rows, items, width):
    norm = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t)) if w]
    grams = defaultdict(set)
    for i, t in items:
        w = norm(t)
        for a in range(max(1, len(w) - width + 1)):
            if w:
                grams[tuple(w[a : a + width])].add(str(i) if i is not None else None)
    out = []
    for d, t in rows:
        w, hit, found = norm(t), set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in grams:
                    hit.update(range(a, a + n))
                    found |= grams[tuple(w[a : a + n])] - {None}
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


ITEMS = [(1, "v1 v2 v0"), (2, "V0, v0; v0. v1"), (10, "v2"), (3, None), (4, ""), (5, "--- !!"), (None, "v1 v1"), (6, "v1 v2 v0 v1 v2 v2 v0"), (7, "v1 v2 v0")]


@pytest.mark.parametrize("small", [50_000, 1], ids=["one set", "many sets"])
def test_leaks_equal_brute_force(spark, edge, empty, small):
    bench = spark.createDataFrame([i + ("x", "y") for i in ITEMS], "item_id long, text string, gram string, h string")
    rows = random_docs(9, 120, 4, 30) + [(500, "V2"), (500, "V2"), (None, "x v2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (3, 10):
        got = decontaminate.leaks(docs, bench, width, small).withColumn("n", F.size(decontaminate.covered())).collect()
        assert Counter((r.doc_id, r.n_words, r.n, tuple(r["items"])) for r in got) == brute_leaks(rows, ITEMS, width)
    got = decontaminate.leaks(edge, bench, 10, small).withColumn("n", F.size(decontaminate.covered())).collect()
    assert Counter((r.doc_id, r.n_words, r.n, tuple(r["items"])) for r in got) == brute_leaks(pairs_of(edge), ITEMS, 10)
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_clean_removes_documents_or_spans(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Zero one TWO, three four"), (2, "one two"), (None, "one two three"), (3, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, bench, 3).collect()) == ["2", "3"]
    spans = {r.doc_id: r.text for r in decontaminate.clean(docs, bench, 3, "spans").collect()}
    assert spans == {1: "zero four", 2: "one two", None: "", 3: None}


# ---- samples of the classifiers


def test_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(3)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    one, two = [f"alba{i}" for i in range(30)], [f"zorn{i}" for i in range(30)]
    rows = [(i, say(one, 10), "a") for i in range(40)] + [(100 + i, say(two, 200), "b") for i in range(40)] + [(200, "1 " * 500 + "zorn1 zorn2 " + "1 " * 500, "c")]
    tagger, names = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=200)
    new = spark.createDataFrame([(1, say(one, 8)), (2, say(two, 8))], "doc_id long, text string")
    assert names == ["a", "b", "c"]
    assert [r.lang_pred for r in language_id.identify(new, tagger, names).orderBy("doc_id").collect()] == ["a", "b"]


def test_toxic_long_texts_are_learned(spark):
    rng = random.Random(4)
    say = lambda n, *more: " ".join(rng.choice([f"plain{i}" for i in range(40)]) if rng.random() < 0.7 or not more else more[0] for _ in range(n))
    docs = [(i, say(20)) for i in range(60)] + [(100 + i, say(300, "vile")) for i in range(60)]
    labels = spark.createDataFrame([(d, int(d >= 100)) for d, _ in docs], "doc_id long, toxic int")
    detector = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), labels, chars=200)
    new = spark.createDataFrame([(1, say(20)), (2, say(300, "vile"))], "doc_id long, text string")
    good, bad = (r.score for r in toxicity.detect(new, detector).orderBy("doc_id").collect())
    assert good < 0.5 < bad


@pytest.mark.parametrize("hot", range(3))
def test_copies_count_once_in_the_draw(spark, monkeypatch, hot):
    rows = [(i, f"hot{hot} text", "a") for i in range(3000)] + [(5000 + i, f"word{i} here", "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("toxic"))
    drawn = []
    for module in (language_id, toxicity):
        real = module.fit
        monkeypatch.setattr(module, "fit", lambda texts, *more, real=real: drawn.append(list(texts)) or real(texts, *more))
    language_id.learn(docs, texts=100)
    toxicity.learn(docs, labels, n_toxic=50, n_clean=50)
    assert all(60 <= len(texts) <= 140 for texts in drawn)
    assert len(set(drawn[0])) == len(drawn[0]) and max(Counter(drawn[1]).values()) <= 2  # the hot text has both labels


# ---- shards


@pytest.mark.parametrize("n, hot, shards", [(600, 200, 7), (300, 300, 5), (10, 0, 24)])
def test_shards_keep_quotas_and_groups(spark, n, hot, shards):
    rows = [(i, "hot" if i < hot else f"t{(i * 7919) % max(1, (n - hot) // 3 or 1)}") for i in range(n)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards).cache()
    counts = Counter(r.shard for r in out.collect())
    assert sum(counts.values()) == n and max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    cut = sharding.cut(out).first()
    if hot == 200:  # every row is linked and every shard full, so rows can only change places; an even spread cuts about 390
        assert cut["cut"] <= 220


@pytest.mark.parametrize("share, size", [(1.0, 2), (0.9, 2), (0.8, 10), (1.0, 10)])
def test_groups_that_fit_stay_whole_where_most_rows_are_linked(spark, share, size):
    n = 2400
    rows = [(i, f"t{i % int(n * share / size)}" if i < n * share else f"alone{i}") for i in range(n)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 24).cache()
    assert set(Counter(r.shard for r in out.collect()).values()) == {100}
    assert tuple(sharding.cut(out).first()) == (n * share, 0)


def test_pairs_change_places_when_all_shards_are_full(spark):
    rows = spark.createDataFrame([(i, i * 7919 % 1200 * 10**15 // 2) for i in range(1200)], "row long, key long")
    links = spark.createDataFrame([(i, f"t{i // 2}") for i in range(1200)], "row long, hub string")
    placed = {r.row: r.shard for r in sharding.propagate(rows, links, [200] * 6).collect()}
    assert Counter(placed.values()) == {s: 200 for s in range(6)}
    assert sum(placed[i] != placed[i + 1] for i in range(0, 1200, 2)) <= 60  # at the start about 500


def test_propagation_places_groups_round_by_round(spark, monkeypatch):
    """From an even start, where every group is cut, each round cuts fewer links; with room left, the rounds alone join nearly all groups."""
    rows = spark.createDataFrame([(i, i * 7919 % 900 * 10**15) for i in range(900)], "row long, key long")
    links = spark.createDataFrame([(i, f"t{i // 6}") for i in range(900)], "row long, hub string")
    cuts = []
    for rounds in (0, 1, 2, 32):
        monkeypatch.setattr(sharding, "MAX_ROUNDS", rounds)
        placed = {r.row: r.shard for r in sharding.propagate(rows, links, [300] * 6).collect()}
        assert len(placed) == 900 and max(Counter(placed.values()).values()) <= 300
        cuts.append(sum(6 - max(Counter(placed[g * 6 + i] for i in range(6)).values()) for g in range(150)))
    assert cuts == sorted(cuts, reverse=True) and cuts[0] >= 400 and cuts[1] < cuts[0] and cuts[-1] <= 15


@pytest.mark.parametrize("seed", range(20))
def test_packing_places_every_row_once(seed):
    rng = random.Random(seed)
    groups = {rng.choice([2, 3, 5, 10, 40, 700]): rng.randint(1, 12) for _ in range(4)}
    rows = sum(k * n for k, n in groups.items())
    quotas = sharding._quotas(rows + rng.choice([0, 1, 50, 1000]), rng.choice([1, 4, 24]))
    held, seen = [0] * len(quotas), Counter()
    for size, begin, end, shard, first, last in sharding._pack(groups, quotas):
        held[shard] += (end - begin) * (last - first)
        seen.update((size, g, r) for g in range(begin, end) for r in range(first, last))
    assert all(h <= q for h, q in zip(held, quotas))
    assert seen == Counter((k, g, r) for k, n in groups.items() for g in range(n) for r in range(k))


def test_shards_edges(edge, empty):
    out = sharding.shard(edge, 4).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((d, len((t or "").encode()) + 8) for d, t in pairs_of(edge))
    assert sharding.shard(empty, 4).count() == 0


def test_multi_hub_links_pull_rows_together(spark):
    rows = spark.createDataFrame([(i, i * 10**15) for i in range(40)], "row long, key long")
    links = spark.createDataFrame([(i, h) for i in range(40) for h in (f"a{i // 10}", f"b{i // 5}")], "row long, hub string")
    placed = {r.row: r.shard for r in sharding.propagate(rows, links, [20] * 4).collect()}
    assert len(placed) == 40 and max(Counter(placed.values()).values()) <= 20
    assert sum(len({placed[i] for i in range(g * 10, g * 10 + 10)}) for g in range(4)) <= 8  # at the start 16: every group in every shard


# ---- language model


def brute_scores(rows, order, alpha):
    grams = [Counter() for _ in range(order + 1)]
    own = []
    for _, t in rows:
        w = split(t)
        mine = [Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
        own.append(mine)
        for n, c in enumerate(mine, 1):
            grams[n].update(c)
    size = sum(grams[1].values())
    out = []
    for (d, t), mine in zip(rows, own):
        w, total = split(t), 0.0
        count = lambda g: grams[len(g)][g] - mine[len(g) - 1][g]
        for i in range(len(w)):
            n, factor = min(order, i + 1), 1.0
            while n > 1 and count(tuple(w[i - n + 1 : i + 1])) <= 0:
                n, factor = n - 1, factor * alpha
            g = tuple(w[i - n + 1 : i + 1])
            s = count(g) / count(g[:-1]) if n > 1 else (count(g) if count(g) > 0 else alpha) / max(1, size - len(w))
            total += math.log(factor * s)
        out.append((d, len(w), round(total, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rows = random_docs(11, 80, 8)
    got = lm_score.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"), order).collect()
    want = brute_scores(rows, order, 0.4)
    assert [g[:2] for g in sorted(((r.doc_id, r.n_words) for r in got), key=str)] == [w[:2] for w in want]
    score = {r.doc_id: r.log_score for r in got}
    assert all(score[d] == pytest.approx(s, abs=1e-5) for d, _, s in want)


def test_bigrams_that_share_32_bits_of_their_names_have_counts_of_their_own(spark):
    n = 400_000
    words = words_of(pa.array([" ".join(f"q{i}" for i in range(n))]))
    names = window_names(words.names, window_starts(words.first, 2)[0], 2)
    short = (names & np.uint64(2**32 - 1)) | (names >> np.uint64(61) << np.uint64(61))  # and lie in one of up to eight buckets
    by = np.argsort(short)
    twins = np.flatnonzero(short[by][1:] == short[by][:-1])
    assert len(twins)
    i, j = by[twins[0]], by[twins[0] + 1]
    rows = [(1, f"q{i} q{i + 1}"), (2, f"q{j} q{j + 1}")]
    got = lm_score.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got) == brute_scores(rows, 2, 0.4)


@pytest.mark.parametrize("buckets", [1, 3, 4, 255, 256, 257, 850, 65_536, 10**6])
def test_packed_names_are_whole(buckets):
    size = blocks.whole_bytes(buckets)
    assert buckets << 8 * size >= 2**64  # the bytes count out a whole bucket
    low, high = 2**64 // buckets * (buckets // 2), 2**64 // buckets * (buckets // 2 + 1)
    keys = np.array([low + 1, low + 2**32 + 1, high - 1], np.uint64)
    assert len(set(blocks.unpack(blocks.pack(keys, size).reshape(-1), size).tolist())) == 3


@pytest.mark.parametrize("order", [3, 4])
def test_blocks_ask_only_for_longer_ngrams_that_others_can_hold(spark, monkeypatch, order):
    rows = random_docs(5, 90, 8) + [(1000 + i, f"u{i} v{i} w{i} shared run of words") for i in range(30)]
    want = {d: s for d, _, s in brute_scores(rows, order, 0.4)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.log_score for r in lm_score.backoff_scores(docs, order).collect()}
    assert all(got[d] == pytest.approx(s, abs=1e-5) for d, s in want.items())
    words = words_of(pa.array(["only here now", "shared run of words"]))
    keys, counts = lm_score._short(words, order)
    pairs = window_names(words.names, window_starts(words.first, 2)[0], 2)
    total = counts + np.isin(keys, pairs[2:])  # another block holds the pairs of the second text
    distinct, here, asked = lm_score._long(words, order, keys, counts, total)
    assert here.tolist() == [1] * len(distinct) and asked.sum() == {3: 2, 4: 3}[order]


def test_a_step_over_a_block_names_its_words_once(monkeypatch):
    texts = pa.array([f"w{i % 7} v{i % 11} u{i} shared run" for i in range(300)])
    named, plain = [], words_module.range_names
    monkeypatch.setattr(words_module, "range_names", lambda values, *rest: named.append(len(values)) or plain(values, *rest))
    words = words_of(texts)
    keys, counts = lm_score._short(words, 3)
    lm_score._long(words, 3, keys, counts, counts + 1)
    assert named.count(len(words.data)) == 1  # was 3, and 5 in the step that scores
    none = pa.table({"block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "reply": pa.array([], pa.binary())})
    docs = pa.table({"doc_id": pa.array(range(300)), "tag": pa.array(range(300)), "text": texts})
    lm_score._score(docs, none, 3, 0.4, 4, True)
    assert named.count(len(words.data)) == 2


@pytest.mark.parametrize("low", [0, 1, 5, 2**63])
def test_names_in_order_are_exact_and_stable(low):
    draw = np.random.default_rng(3)
    names = draw.integers(low, low + 40, 5_000, dtype=np.uint64)  # all share their upper bits
    for n in (names, names[:1], names[:0], draw.permutation(np.append(mixed(names), names))):
        by, ordered = lm_score._ordered(n)
        assert by.tolist() == np.argsort(n, kind="stable").tolist() and ordered.tolist() == sorted(n.tolist())


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5])
def test_windows_of_few_words_have_the_names_of_long_ones(width):
    words = words_of(pa.array(["a b c d e f a b c d e", None, "b c d e f", "a"]))
    starts = window_starts(words.first, width)[0]
    want = words_module.range_names(words.names, starts, starts + width, words_module._BASE)
    assert window_names(words.names, starts, width).tolist() == want.tolist()


@pytest.mark.parametrize("n", [1, 3, 1000, 300_000])
def test_names_as_steps_are_whole_and_short(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    keys[0], keys[-1] = 0, 2**64 - 1
    table = blocks.ask_rows(7, keys, 5, None, np.ones(n, np.int64), blocks.COUNTS)
    back = [blocks.ungapped(b) + np.uint64((int(k) << 64) // 5) for k, b in zip(table["bucket"].to_pylist(), table["keys"].to_pylist())]
    assert np.concatenate(back).tolist() == keys.tolist()
    assert n < 300_000 or sum(map(len, table["keys"].to_pylist())) < 6.3 * n  # whole names took 8 bytes here


@pytest.mark.parametrize("n", [0, 1, 3, 3000])
def test_counts_are_whole_and_short(n):
    counts = np.random.default_rng(n).geometric(0.5, n).astype(np.int64)
    assert n < 3000 or len(blocks.shortened(counts)) < 0.4 * n  # a byte each before
    counts[: n // 2 : 40] = [255, 254, 2**40][n % 3]
    assert blocks.lengthened(blocks.shortened(counts), n).tolist() == counts.tolist()


def test_scores_edges(edge, empty):
    got = sorted((round(r.log_score, 3) for r in lm_score.backoff_scores(edge).collect()))
    assert got == pytest.approx(sorted(round(s, 3) for _, _, s in brute_scores(pairs_of(edge), 3, 0.4)), abs=2e-3)
    assert lm_score.backoff_scores(empty).count() == 0


# ---- tokens


def brute_tokens(text, sections, rule):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    encoded = tokenizer.encode(text, add_special_tokens=False)
    counts, none = [0.0] * len(sections), 0.0
    for a, b in encoded.offsets:
        touched = [(max(0, min(b, e) - max(a, s)), i) for i, (s, e) in enumerate(sections)]
        if rule == "most":
            best = max(touched, key=lambda x: (x[0], -x[1]), default=(0, 0))
            if best[0]:
                counts[best[1]] += 1
            else:
                none += 1
        elif rule == "start":
            at = [i for i, (s, e) in enumerate(sections) if s <= a < e]
            if at:
                counts[at[0]] += 1
            else:
                none += 1
        else:
            for o, i in touched:
                counts[i] += o / (b - a)
            none += 1 - sum(o for o, _ in touched) / (b - a)
    return counts, none


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_equal_offsets_of_another_encoder(spark, rule):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the ", "of", "\n", "\n\n", " ingly", "12 345", "?!", "  ", "x" * 30]) for _ in range(60)) for _ in range(20)]
    given = [(i, sorted(rng.sample(range(len(t)), 8))) for i, t in enumerate(texts)]
    sections = [(i, s[j], s[j + 1]) for i, s in given for j in range(0, 8, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = spark.createDataFrame(sections + [(3, None, 4), (None, 1, 2)], "doc_id long, start int, end int")
    got = defaultdict(dict)
    for r in token_counts.section_tokens(docs, frame, rule).collect():
        got[r.doc_id][r.section] = r.n_tokens
    for i, t in enumerate(texts):
        counts, none = brute_tokens(t, [s[1:] for s in sections if s[0] == i], rule)
        assert [got[i][j] for j in range(4)] == pytest.approx(counts) and got[i][-1] == pytest.approx(none)


def test_tokens_of_lines_and_edges(spark, edge, empty):
    got = token_counts.section_tokens(edge).collect()
    assert sorted(str(r.doc_id) for r in got if r.section == -1) == sorted(str(d) for d, _ in pairs_of(edge))
    fr = [r for r in got if r.doc_id == 7]
    text = dict(pairs_of(edge))[7]
    assert [(r.start, r.end) for r in fr if r.section == 0] == [(0, len(text))]
    assert token_counts.section_tokens(empty).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(edge, rule="never")


# ---- the tagger and what is built on it


def brute_marginals(emit, start, trans):
    n, labels = emit.shape
    out, total = np.zeros((n, labels)), 0.0
    for path in itertools.product(range(labels), repeat=n):
        s = math.exp(start[path[0]] + sum(emit[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        total += s
        for i, y in enumerate(path):
            out[i, y] += s
    return out / total


def test_forward_backward_equals_enumeration(monkeypatch):
    monkeypatch.setattr(crf, "CHUNK", 3)
    rng = np.random.default_rng(2)
    first = np.cumsum([0, 1, 0, 7, 3, 4, 0, 2])
    emit, start, trans = rng.normal(size=(first[-1], 3)) * 2, rng.normal(size=3), rng.normal(size=(3, 3))
    alpha, beta, _, _ = crf.forward_backward(emit, first, start, trans)
    got = alpha * beta / (alpha * beta).sum(axis=1, keepdims=True)
    for a, b in zip(first, first[1:]):
        if b > a:
            assert np.allclose(got[a:b], brute_marginals(emit[a:b], start, trans), atol=1e-9)


def test_language_segments_and_edges(spark, edge, empty):
    rng = random.Random(1)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["quux", "zyzzy", "xorz", "wuzz"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=20)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(100, None, "aa"), (101, "lorem", None), (102, "", "bb")]
    tagger, names = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == ["aa", "bb"]
    mixed = spark.createDataFrame([(1, "lorem ipsum dolor amet lorem ipsum quux xorz")], "doc_id long, text string")
    got = language_id.identify(mixed, tagger, names).first()
    assert got.lang_pred == "aa" and [(s.start, s.end, s.lang) for s in got.segments] == [(0, 6, "aa"), (6, 8, "bb")]
    out = language_id.identify(edge, tagger, names).collect()
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert Counter((r.doc_id, r.lang_pred == "und") for r in out) == Counter((d, not letters(t)) for d, t in pairs_of(edge))
    assert language_id.identify(empty, tagger, names).count() == 0
    nothing, none = language_id.learn(empty)
    assert none == [] and {r.lang_pred for r in language_id.identify(edge, nothing, none).collect()} == {"und"}


def test_toxic_spans_and_edges(spark, edge, empty):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(160):
        words = rng.choices(plain, k=30)
        if i % 4 == 0:
            words[10] = rng.choice(["grubbly", "snarkish", "grubbles"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    labels += [(1000, 1), (None, 1), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    detector = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    new = spark.createDataFrame([(1, "éé word1 Grubbly, word2"), (2, "word3 word4 word5")], "doc_id long, text string")
    bad, good = (r for r in toxicity.detect(new, detector).orderBy("doc_id").collect())
    assert bad.score > 0.5 > good.score and not good.spans
    assert [("éé word1 Grubbly, word2"[s.start : s.end]) for s in bad.spans] == ["Grubbly,"]
    out = toxicity.detect(edge, detector).collect()
    assert len(out) == len(pairs_of(edge)) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.detect(empty, detector).count() == 0
    none = toxicity.learn(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.detect(edge, none).collect())


def test_digest_of_kept_text(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    got = substring_dedup.remove_repeats(docs).select(F.sha2("kept_text", 256).alias("h")).first().h
    assert got == hashlib.sha256(b"").hexdigest()
