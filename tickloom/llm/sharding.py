"""Shards of even size that keep linked documents together: balanced label propagation.

Links are memberships of rows in hubs (here: the text that equal documents share), so a group of any size costs one link a row.
Groups of equal texts start whole, the largest first, each in the shard with most room; only those that fit nowhere are cut.
Rows of other links start evenly spread. In each round, a table of members by hub and shard is counted (map-side combined) and
joined back; a row wants the shard where its hubs have most members. Ties go to open shards, then by a hash of hub, shard and round,
so that the rows of a hub want the same and wants run both ways between two shards. Wants are counted by pair of shards, and quotas let rows
move: one for one between two shards, and one way while the target has room. Where a quota holds some back, a hash of the row decides who moves. Shards that are full and that nobody wants to leave
stop attracting rows, so a group larger than a shard fills the next one. Rows without links fill each shard to its exact size.

The driver sees numbers by pair of shards and by size of group only. Everything else is joins and aggregates in SQL functions; each round is a written
table.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import query, table
from tickloom.llm.prefix import hash_key, sums_before
from tickloom.session import materialize

MAX_ROUNDS = 32  # moves stop by themselves; a bound all the same


def _quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _by_number(number: Column, sizes: list[int]) -> Column:
    """The shard of a gapless number, when shard s takes the next sizes[s] numbers."""
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    return sum((F.when(number >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0)).cast("int")


def _fill(room: list[int], k: int, n: int) -> list[int]:
    """How many of n groups of k rows go whole into each shard, always into the one with most room; all that fit."""
    take = [r // k for r in room]
    if sum(take) <= n:
        return take
    low, high = 0, max(room)  # the room that is left where groups went
    while low < high:
        level = (low + high + 1) // 2
        low, high = (level, high) if sum(max(0, r - level) // k for r in room) >= n else (low, level - 1)
    take = [max(0, r - low) // k for r in room]
    for _ in range(sum(take) - n):  # fewer than there are shards
        take[min((room[s] - take[s] * k, s) for s in range(len(room)) if take[s])[1]] -= 1
    return take


def _pack(groups: dict[int, int], quotas: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, from group, to group, shard, from row, to row) for `groups`, numbers of groups by size, counted inside their size.

    Groups larger than any shard fill shards first; then whole groups, the largest first; last, in pieces, those that fit nowhere.
    """
    room, out, late = list(quotas), [], []
    heap = [(-size, size, 0, n, 0) for size, n in groups.items()]  # rows to place, size, first group, groups, first row
    heapq.heapify(heap)

    def piece(size: int, group: int, row: int) -> int:
        s = max(range(len(room)), key=lambda s: (room[s], -s))
        end = min(size, row + room[s])
        out.append((size, group, group + 1, s, row, end))
        room[s] -= end - row
        return end

    while heap:
        minus, size, begin, n, row = heapq.heappop(heap)
        if -minus > max(quotas):
            for group in range(begin, begin + n):
                end = piece(size, group, row)
                heapq.heappush(heap, (end - size, size, group, 1, end))
            continue
        for s, m in enumerate(_fill(room, -minus, n)):
            if m:
                out.append((size, begin, begin + m, s, row, size))
                room[s] += m * minus
                begin, n = begin + m, n - m
        late += [(size, group, row) for group in range(begin, begin + n)]
    for size, group, row in late:
        while row < size:
            row = piece(size, group, row)
    return out


def _whole(members: DataFrame, plan: list[tuple[int, int, int, int, int, int]], rows: int) -> DataFrame:
    """(row, key, shard) of `members` (row, key, hub, c, nth), where the plan puts them; rows of cut groups by number."""
    text = "array<struct<size:bigint,begin:bigint,end:bigint,shard:int,first:bigint,last:bigint>>"
    names = ("size", "begin", "end", "shard", "first", "last")
    as_json = json.dumps([dict(zip(names, p)) for p in plan])
    at = F.broadcast(members.sparkSession.range(1).select(F.inline(F.from_json(F.lit(as_json), text))))
    here = (F.col("c") == F.col("size")) & (F.col("nth") >= F.col("begin")) & (F.col("nth") < F.col("end"))
    uncut = F.col("last") - F.col("first") == F.col("size")
    whole = members.join(at.where(uncut), here).select("row", "key", "shard")
    if all(last - first == size for size, _, _, _, first, last in plan):
        return whole
    cut = members.join(F.broadcast(at.where(~uncut).select("size", "begin", "end").distinct()), here, "left_semi")
    cut = sums_before(cut.withColumn("one", F.lit(1)), ["hub"], "key", ["row"], "one", "number", rows)
    pieces = cut.join(at.where(~uncut), here & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last")))
    return whole.union(pieces.select("row", "key", "shard"))


def _wants(placed: DataFrame, links: DataFrame, closed: list[int], turn: int) -> DataFrame:
    """(row, key, shard, want, gain): the open shard where the row's hubs have more members than where it is."""
    member = links.join(placed.select("row", "shard"), "row")
    counts = member.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("c")).withColumn("draw", F.xxhash64("hub", "shard", F.lit(turn)))
    at = counts.groupBy("hub").agg(F.collect_list(F.struct("shard", "c", "draw")).alias("at"))  # one entry for each shard at most
    seen = member.join(at, "hub")
    seen = seen.select("row", F.col("shard").alias("own"), F.inline("at"))
    scores = seen.groupBy("row", "own", "shard").agg(F.sum("c").alias("score"), F.max("draw").alias("draw"))
    shut = F.col("shard").isin(closed) if closed else F.lit(False)
    open_ = scores.where((F.col("own") == F.col("shard")) | ~shut)
    best = open_.groupBy("row", "own").agg(F.max(F.struct("score", (~shut).alias("open"), "draw", "shard")).alias("b"))
    return best.select("row", F.col("own").alias("shard"), F.col("b.shard").alias("want")).where("want != shard")


def _allowed(wants: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may move between each two shards: exchanges first, then what room is left, by shard number."""
    out = {(a, b): min(n, wants.get((b, a), 0)) for (a, b), n in wants.items()}
    room = list(room)
    for (a, b), n in sorted(wants.items()):
        more = min(n - out[a, b], room[b])
        out[a, b] += more
        room[b] -= more
    return {pair: n for pair, n in out.items() if n}


def propagate(rows: DataFrame, links: DataFrame, quotas: list[int]) -> DataFrame:
    """(row, key, shard) of linked `rows` (row, key); `links` has (row, hub). No shard exceeds its quota at any time.

    Rows start evenly spread, or in their column `shard` if they have one; that start must keep the quotas.
    """
    shards, placed = len(quotas), rows
    if "shard" not in rows.columns:
        numbered = sums_before(rows.withColumn("one", F.lit(1)), [], "key", ["row"], "one", "number", rows.count())
        placed = numbered.select("row", "key", (F.col("number") % shards).cast("int").alias("shard"))
    placed = materialize(placed, "shards")
    closed: list[int] = []
    for turn in range(MAX_ROUNDS):
        held = dict(placed.groupBy("shard").count().collect())
        room = [q - held.get(s, 0) for s, q in enumerate(quotas)]
        wants = materialize(_wants(placed, links, closed, turn), "wants")
        pairs = {(r[0], r[1]): r[2] for r in wants.groupBy("shard", "want").count().collect()}
        allowed = _allowed(pairs, room)
        left = {a for a, _ in pairs}
        now_closed = [s for s in range(shards) if room[s] == 0 and s not in left]
        if not allowed and now_closed == closed:
            break
        closed = now_closed
        if not allowed:
            continue
        moves = wants.join(placed.select("row", "key"), "row")
        if any(allowed.get(p, 0) < n for p, n in pairs.items()):
            ranked = sums_before(moves.withColumn("one", F.lit(1)), ["shard", "want"], "key", ["row"], "one", "nth", sum(pairs.values()))
            limits = F.create_map(*[F.lit(x) for (a, b), m in allowed.items() for x in (a * shards + b, m)])
            moves = ranked.where(F.col("nth") < F.coalesce(limits[F.col("shard") * shards + F.col("want")], F.lit(0)))
        moved = moves.select("row", F.col("want").alias("to"))
        placed = placed.join(moved, "row", "left").select("row", "key", F.coalesce("to", "shard").alias("shard"))
        placed = materialize(placed, "shards")
    return placed


def shard(docs: DataFrame, shards: int = 24, seed: str = "shard") -> DataFrame:
    """`docs` with (size, shard, slot) for every row: shards 0 ... shards - 1, row counts at most one apart, slots gapless from 0.

    Rows with equal texts are linked. size is the UTF-8 bytes of the text (null: none) plus 8. Null texts have no links; empty
    texts are equal texts. A group is cut only if it is larger than a shard, or if no shard has room for it after the larger ones.
    Rows are told apart by number, so repeated rows and null or repeated ids are rows like any other.
    Columns of `docs` with the names of the new ones are replaced. An empty table gives an empty one.
    """
    base = docs.drop("size", "shard", "slot", "__row").withColumn("__row", F.monotonically_increasing_id())
    base = materialize(base.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8), "rows")
    keyed = base.select(F.col("__row").alias("row"), hash_key(F.lit(seed), F.col("__row").cast("string")).alias("key"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("hub"))
    total = base.count()
    quotas = _quotas(total, shards)
    hubs = keyed.where(F.col("hub").isNotNull()).groupBy("hub").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    hubs = materialize(hubs.withColumn("at", F.conv(F.substring(F.hex("hub"), 1, 15), 16, 10).cast("long")), "hubs")
    groups = dict(hubs.groupBy("c").count().collect())
    hubs = sums_before(hubs.withColumn("one", F.lit(1)), ["c"], "at", ["hub"], "one", "nth", sum(groups.values()))
    links = materialize(keyed.join(hubs, "hub").select("row", "key", "hub", "c", "nth"), "members")
    linked = propagate(_whole(links, _pack(groups, quotas), total), links.select("row", "hub"), quotas)
    held = dict(linked.groupBy("shard").count().collect())
    rest = keyed.select("row", "key").join(linked.select("row"), "row", "left_anti").withColumn("one", F.lit(1))
    rest = sums_before(rest, [], "key", ["row"], "one", "number", total)
    rest = rest.select("row", "key", _by_number(F.col("number"), [q - held.get(s, 0) for s, q in enumerate(quotas)]).alias("shard"))
    everyone = materialize(linked.union(rest), "shards").withColumn("one", F.lit(1))
    slots = sums_before(everyone, ["shard"], "key", ["row"], "one", "slot", total)
    slots = slots.select(F.col("row").alias("__row"), "shard", F.col("slot").cast("long").alias("slot"))
    return base.join(slots, "__row").drop("__row")


def cut(sharded: DataFrame) -> DataFrame:
    """(links, cut): rows that share a text with another, and those of them outside the shard that holds most of their text."""
    by = sharded.where(F.col("text").isNotNull()).groupBy(F.md5(F.col("text").cast("binary")).alias("hub"), "shard").agg(F.count(F.lit(1)).alias("c"))
    hub = by.groupBy("hub").agg(F.sum("c").alias("n"), F.max("c").alias("most")).where("n > 1")
    return hub.agg(F.sum("n").alias("links"), F.sum(F.col("n") - F.col("most")).alias("cut"))


@query("op2_balanced_sharding")
def op2_balanced_sharding(spark, sf_dir):
    """All documents in 24 shards of even row counts; equal texts together as far as the counts allow."""
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return out.select("doc_id", "size", crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
