"""Streaming detection (X1): documents arrive as a stream; every micro-batch is
split into atoms, scored with the frozen bigram model, looked up in a frozen null
grid (stream-static join) and tested per document with the same batch operators.

No state crosses micro-batches (a document is tested when it arrives), so
``foreachBatch`` with the batch DataFrame operators is the whole design; every
batch has its own folder in the sink and a replay overwrites it, so its rows are
there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorscan.operators.corpus import split_sentences
from authorscan.operators.detect import document_tests, sentence_pvalues
from authorscan.operators.lm import BigramLM, score_bigram
from authorscan.params import Params


def detect_batch(docs: DataFrame, lm: BigramLM, grid: DataFrame, params: Params) -> DataFrame:
    """Per-document tests of a batch of ``documents`` rows against a frozen grid
    (grid keyed by the constant ``_k``)."""
    s = split_sentences(docs, ("doc_id",), "text").filter(F.col("length").between(params.min_tokens, params.max_tokens))
    sc = score_bigram(s, lm, decimals=params.response_decimals).withColumn("_k", F.lit(1))
    pv = sentence_pvalues(sc, grid, params, ["_k"], doc_keys=["doc_id"])
    return document_tests(pv, ["doc_id"], params)


def start_detect_stream(stream: DataFrame, lm: BigramLM, grid: DataFrame, params: Params,
                        sink_path: str, checkpoint: str, trigger_once: bool = True):
    def run(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch replaces its own folder
        detect_batch(batch, lm, grid, params).write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
