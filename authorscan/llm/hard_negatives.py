"""Hard-negative mining with Four-Russians scoring.

The components of an anchor fall into groups of eight. For each group a table of 256 entries holds the sum of every subset of the
anchor's eight components. A candidate is stored as bit planes: plane b of a group is one byte, whose bits are bit b of
its eight components (two's complement, the last plane counts negative). The inner product is then a sum over
planes, highest first, each shifted by one bit: all anchors of a block look a candidate's byte up at once and add. Every
pair of an anchor and another row is scored so, in full and exactly; nothing is pruned or approximated.

Two passes over the stored planes: the first finds each anchor's ``positives`` best other rows of its label, the second each
positive's first ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.
A task keeps the best few of each anchor (pass one) or anchor and positive (pass two) of its group of candidates, and a ranking window
merges them; no group of rows is gathered, however common a label or a vector is.

Defined cases: see ``vectors`` for rows that take no part (a null label too) and for unequal lengths; rows that repeat an id are
anchors and candidates each, told apart as rows; rows equal in score and id are interchangeable; an anchor without
positives, or a positive without negatives in its range, gives no row; an empty table gives an empty result; other columns are ignored.
Scores beyond a long are cut to its ends after ranking within a task; a range is then taken of the cut score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authorscan.llm import blocks as B
from authorscan.llm import vectors as V

GROUP = 8
LIMIT = (1 << 63) - 1
NEVER = -(1 << 62)


# -------------------------------------------------------------------- scoring


def planes(m: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes: bit i of a byte is one bit of component 8 * group + i; the last plane is the sign's."""
    rows, width = m.shape
    groups = -(-width // GROUP)
    largest = max(float(m.max(initial=0)), -float(m.min(initial=0)) - 1)
    bits = int(largest).bit_length()
    whole = np.zeros((rows, groups * GROUP), np.int64 if bits < 63 else object)
    whole[:, :width] = m.astype(np.int64) if bits < 63 else np.frompyfunc(int, 1, 1)(m)
    out = np.empty((bits + 1, groups, rows), np.uint8)
    for b in range(bits + 1):
        plane = ((whole >> b) & 1).astype(np.uint8).reshape(rows, groups, GROUP)
        out[b] = np.packbits(plane, axis=2, bitorder="little")[:, :, 0].T
    return out


def tables(m: np.ndarray, dtype) -> np.ndarray:
    """(groups, 256, rows): sums of all subsets of every eight components, each from a smaller subset by one addition."""
    rows, width = m.shape
    groups = -(-width // GROUP)
    whole = np.zeros((rows, groups * GROUP), dtype)
    whole[:, :width] = np.frompyfunc(int, 1, 1)(m) if dtype is object else m.astype(dtype)
    out = np.zeros((groups, 1 << GROUP, rows), dtype)
    for i in range(GROUP):
        out[:, 1 << i:2 << i] = out[:, :1 << i] + whole[:, i::GROUP].T[:, None, :]
    return out


def lookup_scores(table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(rows of ``bits``, anchors): shift-add of table lookups, from the sign plane down."""
    total = None
    for b in range(bits.shape[0] - 1, -1, -1):
        plane = table[0][bits[b, 0]] if table.shape[0] else np.zeros((bits.shape[2], table.shape[2]), table.dtype)
        for g in range(1, bits.shape[1]):
            plane += table[g][bits[b, g]]
        total = -plane if total is None else (total << 1) + plane
    return total


def width_needed(anchors: np.ndarray, n_planes: int):
    """The narrowest type that no subset sum and no partial score leaves."""
    most = float(np.abs(anchors).sum(axis=1).max(initial=0)) * 2.0 ** n_planes
    return np.int32 if most < 2 ** 31 else np.int64 if most < 2 ** 62 else object


def _score(group: list, q: V.Block):
    """(block, scores) of every block of the group; the anchors' tables are made once."""
    made = {}
    for block, bits in group:
        dtype = width_needed(q.vectors, bits.shape[0])
        if dtype not in made:
            made[dtype] = tables(q.vectors, dtype)
        yield block, lookup_scores(made[dtype], bits)


def _joined(found: list[tuple]) -> list[np.ndarray]:
    none = (np.zeros(0, np.int64),) * 3
    return [np.concatenate(c) for c in zip(none, *found, strict=True)]


def _open_planes(data: bytes) -> np.ndarray:
    shape = np.frombuffer(data[:24], np.int64)
    return B.unpack(data[24:], np.uint8)[0].reshape(shape)


def _seal_planes(m: np.ndarray) -> bytes:
    p = planes(m)
    return np.array(p.shape, np.int64).tobytes() + B.pack(p.ravel())


def _long(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(s), -LIMIT - 1), LIMIT) for s in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)


def _leading(scores: np.ndarray, live: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of the live pairs that reach their anchor's k-th best score in this block."""
    if scores.dtype == object or scores.shape[0] <= k:
        return np.nonzero(live)
    least = np.iinfo(scores.dtype).min
    masked = np.where(live, scores, least)
    kth = np.partition(masked, scores.shape[0] - k, axis=0)[scores.shape[0] - k]
    return np.nonzero(live & (masked >= kth[None, :]))


# --------------------------------------------------------------------- passes


def mine(table: DataFrame, label: Column, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         scale: int = 256, vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are rows with a vec_id divisible by ``every``."""
    rows = V.whole_vectors(table, scale, label, vector)
    width = V.width_of(rows)
    candidates = V.seal_vectors(rows.repartition(V.candidate_groups(rows, width), "rid"), width, V.BLOCK_BYTES, _seal_planes)
    anchors = rows.where(F.col("vec_id") % every == 0)

    def hold(blocks, mores):
        for b in blocks:
            b.vectors = b.vectors[:0]  # the planes take their place
        return list(zip(blocks, map(_open_planes, mores), strict=True))

    def positive(group, q):
        found = []
        for x, s in _score(group, q):
            live = (x.label[:, None] == q.label[None, :]) & (x.rid[:, None] != q.rid[None, :])
            j, i = _leading(s, live, positives)
            found.append((i, s[j, i], x.vec_id[j]))
        i, s, vec = _joined(found)
        top = V.first_per(i, s, vec, positives)
        i = i[top]
        return pa.RecordBatch.from_pydict({"rid": q.rid[i], "anchor_id": q.vec_id[i], "positive_id": vec[top], "positive_score": _long(s[top])})

    best = V.meet(candidates, V.query_blocks(anchors, width), hold, positive, "rid long, anchor_id long, positive_id long, positive_score long")
    by_anchor = Window.partitionBy("rid").orderBy(F.desc("positive_score"), "positive_id")
    chosen = B.store(best.withColumn("nth", F.row_number().over(by_anchor).cast("int")).where(F.col("nth") <= positives))
    scores = chosen.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("nth", "positive_score"))).alias("m"))  # ``positives`` at most
    bound = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda n: F.coalesce(F.try_element_at("m", n), F.lit(NEVER)))
    asked = anchors.join(scores, "rid").withColumn("bound", bound).drop("m")

    def negative(group, q):
        least, most = (np.array([[of(p) for p in r] for r in q.bound.tolist()], np.int64).reshape(q.bound.shape) for of in (
            lambda p: LIMIT if p == NEVER else -(-p * low // 100), lambda p: NEVER if p == NEVER else p * high // 100))
        found = []
        for x, s in _score(group, q):
            other = x.label[:, None] != q.label[None, :]
            for nth in range(positives):
                j, i = _leading(s, other & (s >= least[:, nth]) & (s <= most[:, nth]), negatives)
                found.append((i * positives + nth, s[j, i], x.vec_id[j]))
        key, s, vec = _joined(found)
        top = V.first_per(key, s, vec, negatives)
        return pa.RecordBatch.from_pydict({"rid": q.rid[key[top] // positives], "nth": (key[top] % positives + 1).astype(np.int32),
                                           "negative_id": vec[top], "negative_score": _long(s[top])})

    found = V.meet(candidates, V.query_blocks(asked, width), hold, negative, "rid long, nth int, negative_id long, negative_score long")
    by_positive = Window.partitionBy("rid", "nth").orderBy(F.desc("negative_score"), "negative_id")
    first = found.withColumn("rank", F.row_number().over(by_positive).cast("int")).where(F.col("rank") <= negatives)
    return first.join(chosen, ["rid", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
