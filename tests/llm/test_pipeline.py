"""The pipeline's stages on sf0.001: columns, and what each stage must keep and drop."""

import corpus_pipeline
from authorscan.llm.blocks import store
from authorscan.session import read_table
from tests.conftest import SF001
from tests.llm import brute


def test_stages(spark):
    docs = read_table(spark, SF001, "documents")
    columns, seen = docs.columns, {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF001))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    rows = {k: [(r.doc_id, r.text) for r in v] for k, v in seen.items() if k != "packing"}
    assert all(len(brute.words(t)) >= 50 for _, t in rows["quality rules"])
    kept = {r[0]: r for r in brute.line_dedup(rows["quality rules"])}
    import hashlib
    assert all(hashlib.sha256(t.encode()).hexdigest() == kept[i][3] for i, t in rows["line dedup"])
    assert {i for i, _ in rows["simhash near-dedup"]} == {c for _, _, c in brute.simhash_groups(rows["line dedup"])}
    items = [(r.item_id, r.text) for r in read_table(spark, SF001, "benchmark").collect()]
    clean = {r[0] for r in brute.contamination(rows["simhash near-dedup"], items) if not r[5]}
    assert {i for i, _ in rows["benchmark decontamination"]} == clean
    assert {r.doc_id for r in seen["packing"]} == clean
