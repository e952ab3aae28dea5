"""Vector bin packing of examples into training sequences.

Each example has a size vector (tokens, segments, loss-bearing tokens) and each sequence a limit for every component.
``vector_pack`` fills one sequence at a time: of the examples that still fit, it takes the one whose
demand has the largest dot product with the room left, both measured in limits. Examples are
dealt evenly over groups of about ``group`` (a number that does not depend on the data), so a group is one bounded
task however many rows a source has, and every group leaves one partly filled sequence at most.

``pack_documents`` tokenizes whole texts, adds the end id, cuts documents into pieces of ``tokens`` (each a full
sequence) and packs the remainders with ``vector_pack``.

Tokenization is that of ``tokens.ByteTokens``, of every whole text. Strings of special tokens in a text are ordinary text.

Defined cases: null text is empty (the end id alone); repeated rows and ids are packed each; an example larger than a
limit gets a sequence of its own; null sizes count as 0; an empty table gives an empty result; other columns are
ignored by ``pack_documents`` and passed on by ``vector_pack``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorscan.llm import blocks as B
from authorscan.llm.tokens import byte_tokens
from authorscan.session import shuffle_partitions

END_ID = 1
GROUP = 2000
MAX_TASKS = 10_000


# ------------------------------------------------------------------ packing


def fill(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dot-product heuristic: (sequence, order in it) of each row of ``demand`` (rows x components)."""
    n = len(demand)
    scaled = demand / limits
    order = np.lexsort((np.arange(n), *(-scaled.T[::-1])))  # ties: the larger example, then the earlier row
    demand, scaled = demand[order], scaled[order]
    seq, pos = np.full(n, -1), np.zeros(n, np.int64)
    live, k = np.arange(n), 0
    while live.size:
        room, at = limits.astype(np.int64).copy(), 0
        pool = live
        while True:
            pool = pool[(demand[pool] <= room).all(axis=1)]
            if not pool.size:
                break
            best = pool[np.argmax(scaled[pool] @ (room / limits))]
            seq[best], pos[best], at = k, at, at + 1
            room -= demand[best]
            pool = pool[pool != best]
        if not at:  # nothing fits an empty sequence: larger than a limit
            for i in live:
                seq[i], k = k, k + 1
            break
        live, k = live[seq[live] < 0], k + 1
    out_seq, out_pos = np.empty(n, np.int64), np.empty(n, np.int64)
    out_seq[order], out_pos[order] = seq, pos
    return out_seq, out_pos


def vector_pack(examples: DataFrame, sizes: list[str], limits: list[int], group: int = GROUP) -> DataFrame:
    """``examples`` with sequence_id and offset (sum of ``sizes[0]`` before it in its sequence).

    Other columns pass unchanged; input columns named sequence_id or offset are replaced.
    """
    examples = examples.drop("sequence_id", "offset")
    key = B.free_name(examples, "__row")
    rows = B.store(examples.withColumn(key, F.monotonically_increasing_id()))
    n_groups = max(1, -(-rows.count() // group))
    narrow = rows.select(F.col(key).alias("__row"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"s{i}") for i, c in enumerate(sizes)])
    narrow = narrow.withColumn("g", F.pmod(F.xxhash64("__row"), F.lit(n_groups)))
    lim = np.array(limits, np.int64)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("__row")
        demand = np.stack([t.column(f"s{i}").to_numpy() for i in range(len(sizes))], axis=1)
        seq, pos = fill(demand, lim)
        order = np.lexsort((pos, seq))
        length = demand[order, 0]
        before = np.cumsum(length) - length
        first = B.firsts(seq[order])
        offset = np.empty(len(seq), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.r_[first, seq.size]))
        return pa.table({"__row": t.column("__row"), "sequence_id": seq * n_groups + t.column("g").to_numpy(), "offset": offset})

    # a group is little to read and much to pack: as many tasks as groups, not as many as its bytes ask for
    dealt = narrow.repartition(max(shuffle_partitions(rows.sparkSession), min(n_groups, MAX_TASKS)), "g")
    placed = dealt.groupBy("g").applyInArrow(run, "__row long, sequence_id long, offset long").withColumnRenamed("__row", key)
    return rows.join(placed, key).drop(key)


# ------------------------------------------------------------- tokenization


def cut_documents(docs: DataFrame, path: str, tokens: int, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, loss (tokens that have a token before them)."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long"
    out = B.arrow_schema(schema)

    def run(it):
        encode = byte_tokens(path).ids
        for rb in it:
            texts, ids = rb.column("text"), rb.column("doc_id")
            lens = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(lens // (1 << 20))) + 1).tolist(), rb.num_rows] if rb.num_rows else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                rows = []
                for d, text in zip(ids.slice(i, j - i).to_pylist(), texts.slice(i, j - i).to_pylist(), strict=True):
                    got = encode(text) if text else []
                    got.append(end_id)
                    raw, n = np.array(got, "<u4").tobytes(), len(got)
                    for s in range(0, n, tokens):
                        m = min(tokens, n - s)
                        rows.append((d, s, m, zlib.crc32(raw[4 * s:4 * (s + m)]), n, m - (s == 0)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=out)

    return docs.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, tokens: int = 2048, segments: int = 64, loss: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of ``docs``."""
    pieces = cut_documents(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), path, tokens)
    pieces = B.store(pieces.withColumn("row", F.monotonically_increasing_id()))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = pieces.where(F.col("length") == tokens).withColumn("sequence_id", F.col("row") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    rest = vector_pack(pieces.where(F.col("length") < tokens).withColumn("segment", F.lit(1)),
                       ["length", "segment", "loss"], [tokens, segments, loss])
    return whole.select(out).unionByName(rest.withColumn("sequence_id", F.col("sequence_id") * 2).select(out))
