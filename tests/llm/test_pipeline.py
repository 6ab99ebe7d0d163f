"""The stages against plain Python on the smallest tables."""

from collections import Counter

import corpus_pipeline as pipeline
from tests.llm.fixtures import edge_docs, empty_docs
from tests.llm.test_llm_operators import brute_components, brute_leaks, split
from tickloom.llm import mixing
from tickloom.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, [f for _, f in pipeline.STAGES]
    known = materialize(stages[0](spark, docs, SF))
    assert known.columns == columns and known.count() == docs.count()  # the table has no text without a clear language

    rows = [(r.doc_id, r.text) for r in known.collect()]
    want = sorted(d for d, n, c in brute_components(rows) if n == 0 or d == c)
    single = materialize(stages[1](spark, known, SF))
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(d for d, _, hit, _ in brute_leaks([(r.doc_id, r.text) for r in single.collect()], items, 10) if not hit)
    clean = materialize(stages[2](spark, single, SF))
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == want

    taken = {r.doc_id: r.taken for r in mixing.mix(clean).collect()}
    mixed = materialize(stages[3](spark, clean, SF))
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(split(r.text))
    assert mixed.columns == columns and +words == +Counter(taken)

    out = stages[4](spark, mixed, SF).collect()
    counts = Counter(r.shard for r in out)
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in mixed.collect())
    assert max(counts.values()) - min(counts[s] for s in range(24)) <= 1


def test_first_stage_drops_what_has_no_clear_language(spark):
    """Texts without letters go, and those that are like every language alike; texts of the learned languages stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, "1234 5678 ... !!!"), (10**6 + 1, ""), (10**6 + 2, None), (10**6 + 3, "?? -- ??")]
    more = spark.createDataFrame([(d, t, None, "odd", 0) for d, t in odd], docs.schema)
    kept = pipeline.keep_known_languages(spark, docs.unionByName(more), SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stages_take_awkward_tables(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        columns = docs.columns
        for _, stage in pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SF))
            assert docs.columns == columns
        pipeline.STAGES[-1][1](spark, docs, SF).collect()
