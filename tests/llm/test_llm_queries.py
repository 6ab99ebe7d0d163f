"""The queries against their SQL, and the ones without SQL against what can be checked of them."""

import zlib

import pytest

from tests.check import compare, duck
from tickloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), SF, registry.queries()[name], registry.oracles()[name]) is None


def test_language_accuracy_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.queries()["op10_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = registry.queries()["op6_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    clean, bad = ([r for r in held if toxic[r.doc_id] == y] for y in (0, 1))
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in bad for b in clean]
    assert sum(pairs) >= 0.75 * len(pairs)


def test_shards_are_even_and_gapless(spark):
    rows = registry.queries()["op2_balanced_sharding"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, slots, groups = {}, {}, {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(docs[r.doc_id], set()).add(r.shard)
    assert sorted(r.doc_id for r in rows) == sorted(docs) and set(sizes) == set(range(24))
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
