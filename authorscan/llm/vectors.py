"""Whole-number vectors in stored blocks, and the meeting of query blocks with all candidate blocks.

Components become floor(scale * x) with x as a double. A vector that is null, or holds a null, a non-finite component or one that
is no longer finite after scaling, takes no part, nor does a row without an id. Shorter vectors count as padded with zeros
to the longest one's length, so a block's bytes are bounded by its rows: about ``block_bytes`` whatever that length is.

A block is one row with a matrix of vectors, written once under ``spark.checkpoint.dir``. Candidate blocks lie in groups
(one range partition each, about ``group_bytes``); ``meet`` sends every query block to every group as a stream behind the
group's own blocks: a task holds one group and one query block, however many queries there are. A row has an identity of
its own (``rid``), so rows that repeat an id or a vector are told apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authorscan.llm import blocks as B

BLOCK_BYTES = 1 << 20
GROUP_BYTES = 32 << 20
MIN_GROUPS = 32
QUERY_ROWS = 256
EXACT = 2.0 ** 53  # whole numbers below it are exact in a double


@dataclass
class Block:
    vec_id: np.ndarray
    rid: np.ndarray
    label: np.ndarray
    bound: np.ndarray  # rows x numbers that queries carry along
    vectors: np.ndarray  # rows x width, whole numbers as doubles


def whole_vectors(table: DataFrame, scale: int, label: Column | None = None, vector: str = "embedding") -> DataFrame:
    """(rid, vec_id, label, width, norm, v) of the rows that take part, stored; ``v`` is float64 bytes without the zeros at its end."""
    schema = "rid long, vec_id long, label long, width int, norm double, v binary"
    out = B.arrow_schema(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for rb in it:
            rows = []
            lists = rb.column("v")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(scale * flat)
            ends = np.cumsum(sizes)
            odd = np.r_[0, np.cumsum(~np.isfinite(flat))]
            fine = (odd[ends] == odd[ends - sizes]) & lists.is_valid().to_numpy(zero_copy_only=False)
            ids, labels = rb.column("vec_id").to_pylist(), rb.column("label").to_pylist()
            for i in np.flatnonzero(fine).tolist():
                v = flat[ends[i] - sizes[i]:ends[i]]
                used = np.flatnonzero(v)
                v = v[:used[-1] + 1] if used.size else v[:0]
                rows.append(((part << 32) + seen + i, ids[i], labels[i], v.size, float(np.sqrt(v @ v)), v.tobytes()))
            seen += rb.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, out, strict=True)], schema=out)

    given = F.lit(0) if label is None else label
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), given.cast("long").alias("label"), F.col(vector).alias("v"))
    needed = [c for c in ("vec_id", "label", "v")]
    return B.store(rows.dropna(subset=needed).mapInArrow(run, schema))


def width_of(rows: DataFrame) -> int:
    return rows.agg(F.max("width")).first()[0] or 0


def seal_vectors(rows: DataFrame, width: int, block_rows: int, prepare: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """(g, at, n, norm, data, more): blocks of the rows of each partition g in their order; ``more`` is ``prepare`` of their matrix.

    A column ``bound`` (an array, of one length in all rows) goes along."""
    schema = "g int, at int, n int, norm double, data binary, more binary"
    per_block = max(1, min(block_rows, BLOCK_BYTES // (8 * max(width, 1))))
    has_bound = "bound" in rows.columns

    def seal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, at, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row(t: pa.Table) -> pa.RecordBatch:
            m = np.zeros((t.num_rows, width))
            for i, v in enumerate(t.column("v").to_pylist()):
                m[i, :len(v) // 8] = np.frombuffer(v)
            bound = t.column("bound").combine_chunks().flatten().to_numpy() if has_bound else np.zeros(0, np.int64)
            parts = [B.pack(*(t.column(c).to_numpy() for c in ("vec_id", "rid", "label"))), B.pack(bound), B.pack(m.ravel())]
            data = b"".join(len(p).to_bytes(8, "little") + p for p in parts)
            return pa.RecordBatch.from_pydict({
                "g": pa.array([g], pa.int32()), "at": pa.array([at], pa.int32()), "n": pa.array([t.num_rows], pa.int32()),
                "norm": [max(t.column("norm").to_pylist())], "data": pa.array([data], pa.binary()),
                "more": pa.array([prepare(m) if prepare else None], pa.binary())})

        for rb in it:
            held.append(rb)
            size += rb.num_rows
            if size >= per_block:
                t = pa.Table.from_batches(held)
                whole = t.num_rows // per_block * per_block
                for i in range(0, whole, per_block):
                    yield row(t.slice(i, per_block))
                    at += 1
                held, size = t.slice(whole).to_batches(), t.num_rows - whole
        if size:
            yield row(pa.Table.from_batches(held))

    return B.store(rows.mapInArrow(seal, schema), "uncompressed")


def open_vectors(data: bytes, n: int) -> Block:
    parts, at = [], 0
    for dtypes in ([np.int64] * 3, [np.int64], [np.float64]):
        size = int.from_bytes(data[at:at + 8], "little")
        parts += B.unpack(data[at + 8:at + 8 + size], *dtypes)
        at += 8 + size
    return Block(*parts[:3], parts[3].reshape(n, -1), parts[4].reshape(n, -1))


def candidate_groups(rows: DataFrame, width: int) -> int:
    return max(MIN_GROUPS, -(-rows.count() * 8 * max(width, 1) // GROUP_BYTES))


def query_blocks(rows: DataFrame, width: int) -> DataFrame:
    n = max(1, -(-rows.count() // (8 * QUERY_ROWS)))
    return seal_vectors(rows.repartition(n, "rid"), width, QUERY_ROWS)


def meet(candidates: DataFrame, queries: DataFrame, hold: Callable, score: Callable, schema: str) -> DataFrame:
    """``score(group, query block) -> RecordBatch`` for every group of candidate blocks and every query block.

    ``hold(blocks, mores)`` turns a group's blocks, in order, into what ``score`` gets as its group."""
    span = candidates.agg(F.min("g").alias("lo"), F.max("g").alias("hi")).first()
    if span["hi"] is None:
        return candidates.sparkSession.createDataFrame([], schema)
    lo, n = span["lo"], span["hi"] - span["lo"] + 1
    left = candidates.select("g", F.lit(0).alias("side"), F.lit(0).alias("part"), "at", "n", "data", "more")
    right = queries.select(F.explode(F.sequence(F.lit(lo), F.lit(lo + n - 1))).alias("to"), F.lit(1).alias("side"), F.col("g").alias("part"),
                           "at", "n", "data", "more").withColumnRenamed("to", "g")
    both = left.unionByName(right).repartitionById(n, F.col("g") - lo).sortWithinPartitions("g", "side", "part", "at")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks, mores, held = None, [], [], None
        for rb in it:
            for i in range(rb.num_rows):
                g, side, n = (rb.column(c)[i].as_py() for c in ("g", "side", "n"))
                if g != group:
                    group, blocks, mores, held = g, [], [], None
                block = open_vectors(rb.column("data")[i].as_py(), n)
                if side == 0:
                    blocks.append(block)
                    mores.append(rb.column("more")[i].as_py())
                    continue
                if held is None:
                    held = hold(blocks, mores)
                    blocks, mores = [], []
                yield score(held, block)

    return both.mapInArrow(run, schema)


def first_per(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Indices of each group's ``k`` best: higher scores first, ties by smaller id; sorted by group and rank."""
    if score.dtype == object:  # whole numbers beyond a long
        score = np.unique(score, return_inverse=True)[1]
    order = np.lexsort((vec_id, -score, group))
    first = B.firsts(group[order])
    size = np.diff(np.r_[first, order.size])
    return order[np.arange(order.size) - np.repeat(first, size) < k]
