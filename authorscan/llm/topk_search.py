"""Exact top-k search by inner product: norm-sorted candidates, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Candidates are range-partitioned by descending length and stored as blocks in that order. The right singular vectors of the
whole table (eigenvectors of its second-moment matrix, summed in Spark; as wide as a vector, whatever the number of
rows) rotate all vectors, so that the first rotated components carry most of an inner product. A query scans a group's blocks
from the longest vectors on and stops at the first block whose longest vector can't reach its bound; within a block the partial
sums grow over a few cuts, and after each cut a pair goes if partial sum + |rest of q| |rest of x| is below the
query's k-th best score. What is left is scored exactly in whole numbers; the rotation only prunes, with a margin
for its rounding.

Two rounds: the groups of the longest vectors (an eighth) are searched first, and the k-th best scores found there are the other
groups' bounds from the start. Only pairs strictly below a bound go, so ties stay and are broken by the smaller id.

Defined cases: see ``vectors`` for rows that take no part and for unequal lengths; an empty vector scores 0 with every vector;
rows that repeat an id are candidates each and queries each (a query leaves out its own row alone); rows equal in score and id are
interchangeable; a table without queries or candidates gives an empty result; other columns are ignored. Scores beyond a long
are cut to its ends, after ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authorscan.llm import blocks as B
from authorscan.llm import vectors as V

LEAST = -(1 << 63)
ENERGY = (0.5, 0.75, 0.9)  # shares of the table's squared length at which partial sums are cut
DENSE = 0.1  # share of live pairs from which a whole product is cheaper than one pair at a time


# ----------------------------------------------------------------- rotation


def rotation(rows: DataFrame, width: int) -> tuple[np.ndarray, list[int]]:
    """(orthogonal matrix width x width, cuts): directions by falling share of the squared length."""

    def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for rb in it:
            for at in range(0, rb.num_rows, 4096):
                m = _matrix(rb.column(0).slice(at, 4096).to_pylist(), width)
                length = np.sqrt((m * m).sum(axis=1, keepdims=True))
                m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
                total += m.T @ m
        if total.any():
            i = np.repeat(np.arange(width, dtype=np.int32), width)
            yield pa.RecordBatch.from_pydict({"i": i, "j": np.tile(np.arange(width, dtype=np.int32), width), "s": total.ravel()})

    sums = rows.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    second = np.zeros((width, width))
    for r in sums.collect():  # width x width numbers, however many rows
        second[r["i"], r["j"]] = r["s"]
    values, directions = np.linalg.eigh((second + second.T) / 2)
    share = np.cumsum(values[::-1].clip(0)) / max(values.clip(0).sum(), 1e-300)
    cuts = sorted({int(np.searchsorted(share, e)) + 1 for e in ENERGY} - {width})
    return np.ascontiguousarray(directions[:, ::-1]), [c for c in cuts if c < width]


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    m = np.zeros((len(raw), width))
    for i, v in enumerate(raw):
        m[i, :len(v) // 8] = np.frombuffer(v)
    return m


# -------------------------------------------------------------------- search


@dataclass
class _Rotated:
    block: V.Block
    rotated: np.ndarray
    rest: list[np.ndarray]  # length of what lies beyond each cut
    length: np.ndarray

    @classmethod
    def of(cls, block: V.Block, turn: np.ndarray, cuts: list[int]) -> _Rotated:
        r = block.vectors @ turn
        left = np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1]  # squared length from a component on
        length = np.sqrt((block.vectors ** 2).sum(axis=1))
        return cls(block, r, [np.sqrt(left[:, c]) for c in cuts], length)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the paired rows of ``q`` and ``x`` in whole numbers."""
    if q.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] >= V.EXACT:
        whole = np.frompyfunc(int, 1, 1)
        return (whole(q) * whole(x)).sum(axis=1)
    return np.einsum("ij,ij->i", q, x).astype(np.int64)


def live_pairs(q: _Rotated, x: _Rotated, rows: np.ndarray, bound: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that no partial sum rules out; ``bound`` by row of ``rows``."""
    cols = np.arange(x.length.size)
    margin = 1e-9 * q.length[rows]  # rounding of the rotation: far less than 1e-9 |q| |x|
    partial, at = np.zeros((rows.size, cols.size)), 0
    alive = np.ones((rows.size, cols.size), bool)
    for k, c in enumerate(cuts):
        partial += q.rotated[rows, at:c] @ x.rotated[cols, at:c].T
        best = partial + q.rest[k][rows][:, None] * x.rest[k][cols][None, :]
        alive &= ~(best + margin[:, None] * x.length[cols][None, :] < bound[:, None])
        at = c
        i, j = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not i.size or alive.mean() < DENSE:
            break
        if i.size < rows.size or j.size < cols.size:
            rows, bound, margin, cols = rows[i], bound[i], margin[i], cols[j]
            partial, alive = partial[np.ix_(i, j)], alive[np.ix_(i, j)]
    i, j = np.nonzero(alive)
    for k, c in enumerate(cuts):  # few pairs are left: one at a time
        if c <= at or not i.size:
            continue
        more = np.einsum("ij,ij->i", q.rotated[rows[i], at:c], x.rotated[cols[j], at:c])
        partial[i, j] += more
        best = partial[i, j] + q.rest[k][rows[i]] * x.rest[k][cols[j]] + margin[i] * x.length[cols[j]]
        keep = ~(best < bound[i])
        i, j, at = i[keep], j[keep], c
    return rows[i], cols[j]


class _Best:
    """The best ``k`` of every query of a block so far."""

    def __init__(self, bound: np.ndarray, k: int):
        self.k, self.bound = k, bound.copy()
        self.query = self.vec_id = self.score = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        keep = (score >= self.bound[query]) | (self.bound[query] == LEAST)
        query, vec_id, score = (np.r_[a, b[keep]] for a, b in ((self.query, query), (self.vec_id, vec_id), (self.score, score)))
        top = V.first_per(query, score, vec_id, self.k)
        self.query, self.vec_id, self.score = query[top], vec_id[top], score[top]
        last = np.flatnonzero(np.bincount(self.query, minlength=self.bound.size) == self.k)
        if last.size:
            ends = np.searchsorted(self.query, last, "right") - 1
            worst = np.array([min(max(int(s), LEAST), -LEAST - 1) for s in self.score[ends]], np.int64)
            self.bound[last] = np.maximum(self.bound[last], worst)


def _search(group: list[_Rotated], q: _Rotated, k: int, cuts: list[int]) -> _Best:
    best = _Best(q.block.bound[:, 0], k)
    for x in group:  # from the longest vectors on
        rows = np.flatnonzero(~(q.length * x.length.max() * (1 + 1e-9) < best.bound))
        if not rows.size:
            break  # the blocks after it hold shorter ones
        fresh = rows[best.bound[rows] == LEAST]
        i, j = (np.concatenate(p) for p in zip(
            (np.repeat(fresh, x.length.size), np.tile(np.arange(x.length.size), fresh.size)),
            live_pairs(q, x, np.setdiff1d(rows, fresh), best.bound[np.setdiff1d(rows, fresh)], cuts), strict=True))
        own = q.block.rid[i] == x.block.rid[j]
        i, j = i[~own], j[~own]
        for at in range(0, i.size, 1 << 16):
            a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            best.add(a, x.block.vec_id[b], exact_scores(q.block.vectors[a], x.block.vectors[b]))
    return best


def top_k(table: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows for every row whose vec_id is divisible by ``every``."""
    rows = V.whole_vectors(table, scale, vector=vector)
    width = V.width_of(rows)
    turn, cuts = rotation(rows, width) if width else (np.zeros((0, 0)), [])
    groups = V.candidate_groups(rows, width)
    by_length = rows.repartitionByRange(groups, F.desc("norm"), "rid").sortWithinPartitions(F.desc("norm"), "rid")
    candidates = V.seal_vectors(by_length, width, V.BLOCK_BYTES)
    asked = rows.where(F.col("vec_id") % every == 0)

    def hold(blocks, _):
        return [_Rotated.of(b, turn, cuts) for b in blocks]

    def score(group, block):
        best = _search(group, _Rotated.of(block, turn, cuts), k, cuts)
        clipped = np.array([min(max(int(s), LEAST), -LEAST - 1) for s in best.score], np.int64)
        return pa.RecordBatch.from_pydict({"rid": block.rid[best.query], "query_id": block.vec_id[best.query], "vec_id": best.vec_id, "score": clipped})

    def search(some, bounds):
        return V.meet(some, V.query_blocks(bounds, width), hold, score, "rid long, query_id long, vec_id long, score long")

    ranked = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    last = (candidates.agg(F.max("g")).first()[0] or 0) // 8  # the groups of the longest vectors
    head = B.store(search(candidates.where(F.col("g") <= last), asked.withColumn("bound", F.array(F.lit(LEAST)))))
    kth = B.store(head.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("rid", F.col("score").alias("bound")))
    bounded = asked.join(kth, "rid", "left").withColumn("bound", F.array(F.coalesce("bound", F.lit(LEAST))))
    rest = search(candidates.where(F.col("g") > last), bounded)
    out = head.unionByName(rest).withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
