"""Similarity join of documents on word n-grams, by vertical partitioning of one global n-gram order.

The global order is (number of blocks that hold the n-gram, its name): rare first, the same for every document.

1. Every block of documents asks once for each of its n-grams how many blocks hold it. A document links with another only if
   at least `percent` of its own n-grams occur elsewhere; all others are settled here and never move again.
2. Documents with the same set collapse to one representative.
3. Two sets that link share an n-gram among the first n - ceil(percent * n / 100) + 1 of the global order. These prefix
   postings give candidates: first, in a few turns, each set with the hub outside its group that it shares most prefix
   n-grams with, which finds the groups; then, for n-grams whose holders still lie in different groups, every pair across
   groups that passes a bound on sizes and on what two prefixes share. So no pairs inside a found group are made, and none
   that could link two groups is missed.
4. Candidates are compared fragment by fragment: the name range is cut into fragments, each document's set into segments, the
   overlap of two segments is counted by itself, and the counts are summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.blocks import answer_rows, answers, ask, ask_rows, conclude, deal_for, dealt, holders, pack, read_replies, unpack
from tickloom.llm.common import bucketed, query, table
from tickloom.llm.graph import components
from tickloom.llm.words import distinct_by_owner, mixed, range_names, window_names, window_starts, words_of
from tickloom.session import materialize

ASK_BYTES = 3  # and the bucket's bits; two n-grams that fall together only look shared, which adds candidates
BUCKET_KEYS = 100_000
SET_BYTES = 6
SEGMENT_KEYS = 4096
LIST_SETS = 1024
MEMBER = np.dtype([("sig", "V16"), ("n", "<i4"), ("rest", "<i4")])
KEYED = np.dtype([("high", "<u8"), ("low", "<u8"), ("rest", "<u8")])  # the same bytes as numbers, which numpy can sort
SETS = "doc_id long, tag long, n_shingles long, sig binary, shared binary, held int, lead int"


def shingles(texts: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle name), sorted; fewer than `width` words make one shingle of all of them."""
    words = words_of(texts, lower=True)
    names = words.names
    starts, owner = window_starts(words.first, width)
    few = np.flatnonzero((words.counts > 0) & (words.counts < width))
    whole = range_names(names, words.first[few], words.first[few + 1])
    return distinct_by_owner(np.concatenate([owner, few]), np.concatenate([window_names(names, starts, width), whole]))[:2]


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    cuts = np.searchsorted(owner, np.arange(n + 1))
    return total[cuts[1:]] - total[cuts[:-1]]


def _settle(docs: pa.Table, replies: pa.Table, width: int, percent: int, buckets: int) -> pa.Table:
    n = docs.num_rows
    owner, keys = shingles(docs["text"], width)
    own, inverse, local = np.unique(keys, return_inverse=True, return_counts=True)
    blocks = read_replies(replies, own, buckets, np.uint8)[inverse]
    shared = (blocks > 1) | (local[inverse] > 1)
    size = np.bincount(owner, minlength=n)
    live = (size > 0) & (100 * np.bincount(owner, shared, minlength=n) >= percent * size)
    live &= ~np.asarray(pc.is_null(docs["doc_id"]).combine_chunks().to_numpy(zero_copy_only=False), bool)
    cuts = np.searchsorted(owner, np.arange(n + 1))
    with np.errstate(over="ignore"):
        first, second = _sums(owner, mixed(keys), n), _sums(owner, mixed(keys ^ np.uint64(0xA5A5A5A5)), n)
    sig, shared_keys, held, lead = [None] * n, [None] * n, [None] * n, [None] * n
    for i in np.flatnonzero(live):
        k, s, b = (x[cuts[i] : cuts[i + 1]] for x in (keys, shared, blocks))
        sig[i] = np.array([first[i], second[i] ^ mixed(np.uint64([len(k)]))[0]], np.uint64).tobytes()
        order = np.lexsort((k, b))
        place = np.flatnonzero(s[order])
        shared_keys[i], held[i] = pack(k[order[place]], SET_BYTES).tobytes(), len(place)
        lead[i] = int(np.searchsorted(place, len(k) - -(-percent * len(k) // 100) + 1))
    return pa.table(
        {
            "doc_id": docs["doc_id"],
            "tag": docs["tag"],
            "n_shingles": pa.array(size, pa.int64()),
            "sig": pa.array(sig, pa.binary()),
            "shared": pa.array(shared_keys, pa.binary()),
            "held": pa.array(held, pa.int32()),
            "lead": pa.array(lead, pa.int32()),
        }
    )


def _few(keys: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return np.minimum(holders(keys, extra), 255).astype(np.uint8)


def document_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Set size of every document; for those that can link at all also the signature, the shared n-grams in the global order, and
    how many of them there are (`held`) and the prefix has (`lead`)."""
    rows = docs.select("doc_id", "text").withColumn("tag", F.xxhash64("text"))
    deal = deal_for(rows, bucket_keys=BUCKET_KEYS)
    buckets = deal.buckets

    def asks(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return ask_rows(key[0].as_py(), np.unique(shingles(t["text"], width)[1]), buckets, ASK_BYTES)

    def reply(t: pa.Table) -> pa.Table:
        return answer_rows(t, ASK_BYTES, _few)

    def settle(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        return _settle(t, replies, width, percent, buckets)

    blocked = dealt(rows, deal)
    return conclude(blocked, answers(ask(blocked, asks), reply), settle, SETS)


def _keys(blob: bytes, n: int | None = None) -> np.ndarray:
    return unpack(np.frombuffer(blob, np.uint8, -1 if n is None else n * SET_BYTES), SET_BYTES)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One posting for each shared n-gram of each prefix."""
    for batch in batches:
        sigs, blobs, leads = (batch.column(c).to_pylist() for c in ("sig", "shared", "lead"))
        keys = [_keys(b, n) for b, n in zip(blobs, leads)]
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()).take(pa.array(owner)), pa.array(flat.view(np.int64))], ["sig", "key"])


def linked(pairs: DataFrame, reps: DataFrame, fragments: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap, counted fragment by fragment and summed, reaches the threshold.

    `reps` is bucketed by `sig`, so only the segments of a travel, to where the sets of b lie.
    """
    inner = np.array([(f << (8 * SET_BYTES)) // fragments for f in range(1, fragments)], np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, n, blob in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "shared"))):
                keys = np.sort(_keys(blob))
                rows += [(a, b, n, f, pack(part, SET_BYTES).tobytes()) for f, part in enumerate(np.split(keys, np.searchsorted(keys, inner)))]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "na", "frag", "seg"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for f, seg, blob in zip(*(batch.column(c).to_pylist() for c in ("frag", "seg", "shared"))):
                keys = _keys(blob)
                own = keys[np.searchsorted(inner, keys, side="right") == f] if fragments > 1 else keys
                found.append(len(np.intersect1d(_keys(seg), own)))
            kept = [batch.column(c) for c in ("a", "b", "na")]
            yield pa.RecordBatch.from_arrays([*kept, batch.column("n"), pa.array(found, pa.int64())], ["a", "b", "na", "nb", "part"])

    segments = pairs.join(reps.select("sig", "n", "shared"), F.col("a") == F.col("sig")).select("a", "b", "n", "shared")
    segments = segments.mapInArrow(cut, "a binary, b binary, na long, frag int, seg binary")
    met = segments.join(reps.select("sig", "n", "shared"), F.col("b") == F.col("sig")).select("a", "b", "na", "frag", "seg", "n", "shared")
    parts = met.mapInArrow(count, "a binary, b binary, na long, nb long, part long")
    return parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both")).where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def _grouped(postings: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Postings with the group of each set; a set without links is its own group."""
    if groups is None:
        return postings.withColumn("g", F.col("sig"))
    joined = postings.join(groups, postings["sig"] == groups["node"], "left")
    return joined.select("key", "sig", F.coalesce("component", "sig").alias("g"))


def _star_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """Each set with the hub outside its group that it shares most prefix n-grams with.

    Every n-gram has one hub, drawn by hash and anew each turn, so a turn makes at most one pair for each posting. Turn t tries
    the best 2^t hubs of each set, for the fewer sets that are still open.
    """
    drawn = F.min(F.struct(F.xxhash64("sig", F.lit(turn)).alias("h"), "sig", "g")).alias("hub")
    hubs = placed.groupBy("key").agg(drawn, F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi")
    hubs = hubs.select("key", F.col("hub.sig").alias("hub"), F.col("hub.g").alias("hub_g"))
    seen = placed.join(hubs, "key").where("g != hub_g").groupBy("sig", "hub").agg(F.count(F.lit(1)).alias("c"))
    best = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("c"), "hub"))  # at most a prefix of rows for each set
    return seen.withColumn("nth", best).where(F.col("nth") <= 2**turn).select(F.col("sig").alias("a"), F.col("hub").alias("b"))


def _pairs_across(placed: DataFrame) -> float:
    """How many pairs across groups the postings would make, from counts alone."""
    held = placed.groupBy("key", "g").agg(F.count(F.lit(1)).alias("c"))
    by_key = held.groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return by_key.agg(F.sum((F.col("s").cast("double") * F.col("s") - F.col("q")) / 2)).first()[0] or 0.0


def _members(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of all lists of a column as records, their groups as two numbers each, and the bounds of the lists."""
    values = column.flatten()
    out = np.empty(len(values), MEMBER)
    out["sig"] = np.frombuffer(b"".join(values.field("sig").to_pylist()), "V16")
    out["n"], out["rest"] = values.field("n").to_numpy(), values.field("rest").to_numpy()
    groups = np.frombuffer(b"".join(values.field("g").to_pylist()), "<u8").reshape(-1, 2)
    return out, groups, np.append(0, np.cumsum(column.value_lengths().to_numpy()))


def _cross_pairs(placed: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Every pair of sets in different groups that shares a prefix n-gram and can still reach the threshold.

    The sets that hold an n-gram are cut into lists of about LIST_SETS by their signature, and every two lists of an n-gram
    meet in one row. A row gives each set of the left list its partners of the right one, packed. The partners of a set from all
    its n-grams, list by list, tell how many prefix n-grams each pair shares; besides those, two sets share at most the larger
    of what they hold beyond their prefixes.
    """
    open_keys = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi").select("key", "m")
    lists = max(1, -(-(open_keys.agg(F.max("m")).first()[0] or 0) // LIST_SETS))
    facts = reps.select("sig", F.col("n").cast("int").alias("n"), (F.col("held") - F.col("lead")).alias("rest"))
    rows = placed.join(open_keys.select("key"), "key").join(facts, "sig").withColumn("part", F.pmod(F.xxhash64("sig"), F.lit(lists)).cast("int"))
    sides = rows.groupBy("key", "part").agg(F.collect_list(F.struct("sig", "g", "n", "rest")).alias("sets"))
    met = sides.select("key", F.col("sets").alias("left")).join(sides.select("key", "part", F.col("sets").alias("right")), "key")

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, lg, lc), (right, rg, rc) = _members(batch.column("left")), _members(batch.column("right"))
            found: list[tuple] = []
            for i, part in enumerate(batch.column("part").to_pylist()):
                a, ag, b, bg = left[lc[i] : lc[i + 1]], lg[lc[i] : lc[i + 1]], right[rc[i] : rc[i + 1]], rg[rc[i] : rc[i + 1]]
                for j in range(len(a)):
                    ok = (bg[:, 0] > ag[j, 0]) | ((bg[:, 0] == ag[j, 0]) & (bg[:, 1] > ag[j, 1]))
                    ok &= 100 * np.minimum(a["n"][j], b["n"]) >= percent * np.maximum(a["n"][j], b["n"])
                    if ok.any():
                        found.append((a["sig"][j].tobytes(), part, int(a["n"][j]), int(a["rest"][j]), b[ok].tobytes()))
            columns = list(zip(*found)) or [[]] * 5
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "part", "n", "rest", "partners"])

    def counted(t: pa.Table) -> pa.Table:
        a, n, rest = (t[c][0].as_py() for c in ("a", "n", "rest"))
        sets, c = np.unique(np.frombuffer(b"".join(t["partners"].to_pylist()), KEYED), return_counts=True)
        b = sets.view(MEMBER)
        close = (100 + percent) * (c + np.maximum(rest, b["rest"])) >= percent * (n + b["n"].astype(np.int64))
        kept = [x.tobytes() for x in b["sig"][close]]
        return pa.table({"a": pa.array([a] * len(kept), pa.binary()), "b": pa.array(kept, pa.binary())})

    packed = met.mapInArrow(partners, "a binary, part int, n long, rest long, partners binary")
    return packed.groupBy("a", "part").applyInArrow(counted, "a binary, b binary")


def similarity_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, tag, n_shingles, component_id) for every row of `docs` (doc_id, text; other columns are ignored).

    Two documents link when 100 * |A and B| >= percent * |A or B| over their distinct lower-cased word shingles; a text of fewer
    words is one shingle; null and empty texts have none and link with nothing. component_id is the smallest reachable doc_id.
    `tag` is a hash of the text that tells rows with one doc_id apart. Rows with a null doc_id keep their size, link with
    nothing and have a null component. Repeated rows come back as often as they came. An empty table gives an empty one.
    """
    sets = materialize(document_sets(docs, width, percent), "sets")
    live = sets.where(F.col("sig").isNotNull())
    payload = F.struct(F.col("n_shingles").alias("n"), "shared", "held", "lead")
    chosen = live.groupBy("sig").agg(F.min_by(payload, F.struct("doc_id", "tag")).alias("r")).select("sig", "r.*")
    reps = bucketed(chosen, "sig", "reps")
    longest, size = reps.agg(F.max("n"), F.count(F.lit(1))).first()
    fragments = max(1, -(-(longest or 0) // SEGMENT_KEYS))
    postings = reps.select("sig", "shared", "lead").mapInArrow(_prefixes, "sig binary, key long")
    shared_keys = postings.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo != hi").select("key")
    postings = materialize(postings.join(shared_keys, "key"), "postings")
    entries = postings.count()

    # Turns go on while they link many sets and the pairs across groups would far outnumber the postings; then all pairs left are made.
    placed, links, turn = _grouped(postings, None), None, 0
    while turn == 0 or (50 * star.count() > size and _pairs_across(placed) > 10 * entries):
        star = materialize(linked(_star_pairs(placed, turn), reps, fragments, percent), "links")
        links = star if links is None else links.union(star)
        placed = materialize(_grouped(postings, components(links, "a", "b", rounds=2)), "placed")
        turn += 1
    rest = linked(_cross_pairs(placed, reps, percent), reps, fragments, percent)
    groups = components(links.union(rest), "a", "b")

    named = live.select("sig", "doc_id").join(groups, F.col("sig") == groups["node"], "left")
    named = named.groupBy(F.coalesce("component", "sig").alias("g"), "sig").agg(F.min("doc_id").alias("m"))
    smallest = named.groupBy("g").agg(F.min("m").alias("component_id"))
    by_sig = named.select("sig", "g").join(smallest, "g").select("sig", "component_id")
    rest = sets.where(F.col("sig").isNull()).select("doc_id", "tag", "n_shingles", F.col("doc_id").alias("component_id"))
    return live.join(by_sig, "sig").select("doc_id", "tag", "n_shingles", "component_id").union(rest)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, p.b FROM r JOIN p ON r.y = p.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = s.doc_id
"""


@query("op5_ngram_jaccard_join", ORACLE)
def op5_ngram_jaccard_join(spark, sf_dir):
    """Components of all documents under five-word shingles and a similarity of 0.75."""
    return similarity_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
