"""A cleaning pipeline over ``documents``: each stage calls one operator of ``authorscan.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences. A stage's result is written and read again before the next
stage starts; so each stage first removes what earlier ones stored on their way.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from authorscan.llm.blocks import store
from authorscan.llm.decontamination import decontaminate
from authorscan.llm.line_dedup import dedup_lines
from authorscan.llm.packing import pack_documents
from authorscan.llm.quality_rules import quality_filter
from authorscan.llm.queries import tokenizer_path
from authorscan.llm.simhash import near_dedup
from authorscan.session import read_table, recorded_stages, remove_stages

BLOCK_BYTES = 1 << 20  # of text: a block's row stays small for the JVM, whose stages share an executor with the Python workers
_left: list = []  # stage tables of the stages before
_result: list = []  # the last stage's DataFrame


def stage(f):
    """``f``, with the tables removed that the stages before it left (not if ``docs`` is a stage's result itself, unwritten)."""

    @functools.wraps(f)
    def run(spark, docs, sf_dir):
        if not any(docs is r for r in _result):
            remove_stages(spark, _left)
            _left.clear()
        with recorded_stages() as written:
            out = f(spark, docs, sf_dir)
        _left.extend(written)
        _result[:] = [out]
        return out

    return run


@stage
def quality_rules(spark, docs, sf_dir):
    """Documents that fail the rules go."""
    return quality_filter(docs, read_table(spark, sf_dir, "labels"))


@stage
def line_dedup(spark, docs, sf_dir):
    """Lines that stand, or nearly stand, earlier go; ``n_chars`` follows the text."""
    return dedup_lines(docs, block_bytes=BLOCK_BYTES).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return near_dedup(docs, shingle=4, radius=4, block_bytes=BLOCK_BYTES)


@stage
def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark passage go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), window=10, block_bytes=BLOCK_BYTES)


@stage
def packing(spark, docs, sf_dir):
    """What is left becomes training sequences."""
    return pack_documents(docs, tokenizer_path(), tokens=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: XXH64, edit distances, components and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = read_table(spark, sf_dir, "documents"), []
    for _, apply in STAGES:
        result = apply(spark, docs, sf_dir)
        with recorded_stages() as written:
            docs = store(result)
        remove_stages(spark, before)  # the stage that read it is done
        before = written
    return docs
