"""Plan-shape guards for the scale rules: no cartesian / nested-loop joins, no
row-at-a-time Python UDFs, pruned reads of the text table."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", ["sentence_atoms", "edit_budget", "ngram_logloss", "doc_hc", "exact_pvalue",
                                  "roc", "calibrate", "fold_roles"])
def test_no_forbidden_operators(spark, name):
    df = E.queries()[name](spark, SF001)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plan contains {op}"


def test_documents_scan_is_pruned(spark):
    from authorscan.sources.articles import document_sentences
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = document_sentences(docs)._jdf.queryExecution().executedPlan().toString()
    schema = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)[0]
    assert "n_chars" not in schema and "text" in schema
