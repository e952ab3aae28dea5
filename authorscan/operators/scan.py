"""Skew-safe ordered scans (running sums / maxima / minima per key).

A window ``partitionBy(key).orderBy(x)`` sends every row of a key to one task, so
one hot document or topic holding a third of the rows becomes one task. ``scan``
instead range-partitions on ``(key, order)`` (a hot key is cut across many
partitions by the sampled bounds), runs the window inside each
``(partition, key)`` cell, and adds the carry of the earlier (or later)
partitions of the same key. Only the first and last key of a range partition
can span partitions, so the carry table has at most ``2 * partitions`` rows —
a proven bound, broadcast safely. The ranged rows are checkpointed (reliable
checkpoint into ``spark.checkpoint.dir``), so ``scan`` runs one job when called.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authorscan.session import cut_lineage, shuffle_partitions

_FRAMES = {
    "upto": (Window.unboundedPreceding, Window.currentRow),
    "before": (Window.unboundedPreceding, -1),
    "from": (Window.currentRow, Window.unboundedFollowing),
    "after": (1, Window.unboundedFollowing),
    "all": (Window.unboundedPreceding, Window.unboundedFollowing),
}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Acc:
    """One running aggregate: ``fn`` over ``col`` of the rows in ``frame``.

    frame: ``upto`` (order <= current), ``before`` (<), ``from`` (>=), ``after`` (>), ``all`` (the key's rows).
    """

    out: str
    fn: str
    col: object
    frame: str


MAX_BUCKETS = 100_000  # what Spark allows
MOST_VALUES = 10_000  # of more partitions, each bucket has a few

# A frame that runs to the end of its cell is read anew for every row, which is quadratic in the cell:
# its sum is the cell's less the sum of the rows before it, or it is taken in falling order.
_MIRROR = {"from": "upto", "after": "before"}


def _sum_behind(v: Column, cell, frame: str) -> Column:
    """Sum of the integers from (after) the current row on; NULL if there are none."""
    rest = _FRAMES["before" if frame == "from" else "upto"]
    whole = cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    some = F.count(v).over(whole) > F.count(v).over(cell.rowsBetween(*rest))
    return F.when(some, F.sum(v).over(whole) - F.coalesce(F.sum(v).over(cell.rowsBetween(*rest)), F.lit(0)))


@lru_cache
def _bucket_values(n: int) -> list[int]:
    """``n`` rising integers of which each falls into another of Spark's ``n`` hash buckets (by Murmur3 with seed 42): with 0, 1, ...
    a bucket may get several partitions, and as many others none."""
    u, turned = np.uint32, lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    out, used, at = [], np.zeros(n, bool), 0
    while len(out) < n:
        v = np.arange(at, at + 4 * n + 64, dtype=np.uint32)
        h = turned(turned(v * u(0xCC9E2D51), 15) * u(0x1B873593) ^ u(42), 13) * u(5) + u(0xE6546B64) ^ u(4)
        h = (h ^ h >> u(16)) * u(0x85EBCA6B)
        h = (h ^ h >> u(13)) * u(0xC2B2AE35)
        bucket = (h ^ h >> u(16)).view(np.int32).astype(np.int64) % n
        first = np.unique(bucket, return_index=True)[1]
        new = np.sort(first[~used[bucket[first]]])
        out, at = out + v[new].tolist(), at + len(v)
        used[bucket[new]] = True
    return out


def _partition_number(n: int) -> Column:
    """A number of the row's partition that rises with it; of up to ``n`` partitions, each has a bucket of its own."""
    values, pid = _bucket_values(n), F.spark_partition_id()
    return F.coalesce(F.get(F.lit(values), pid), pid + F.lit(values[-1] + 1))


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_safe_join(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi join on ``cols`` where NULL matches NULL; keeps the left copies."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"__r_{c}"]) for c in cols])
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in cols])


def scan(df: DataFrame, keys: list[str], order: list, accs: list[Acc],
         num_partitions: int | None = None) -> DataFrame:
    """Add running aggregates over ``order`` (ascending) within each ``keys`` group.

    ``(keys, order)`` must identify a row (break ties before calling).
    """
    keys = list(keys)
    order = [_as_col(o) for o in order]
    n = num_partitions or shuffle_partitions(df.sparkSession)
    vals = {f"_sv{i}": _as_col(a.col) for i, a in enumerate(accs)}
    # Every branch below must see the same range bounds, so the ranged rows and
    # their partition ids are written once to the shared checkpoint folder
    # (spark.checkpoint.dir). This also cuts the lineage: later plans start
    # from the stored rows, and a lost executor re-reads them instead of
    # re-sampling the bounds. They lie in buckets of the partition id, so the windows below shuffle nothing;
    # the values follow from the row and aren't stored.
    ranged = cut_lineage(df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
                         .withColumn("_pid", _partition_number(n) if n <= MOST_VALUES else F.spark_partition_id()), "_pid", min(n, MAX_BUCKETS)).withColumns(vals)

    cell = Window.partitionBy("_pid", *keys).orderBy(*order)
    back = Window.partitionBy("_pid", *keys).orderBy(*[o.desc() for o in order])
    local = {}
    for i, a in enumerate(accs):
        v = F.col(f"_sv{i}")
        if a.frame in ("upto", "before", "all"):
            local[f"_sl{i}"] = _AGG[a.fn](v).over(cell.rowsBetween(*_FRAMES[a.frame]))
        elif a.fn == "sum" and isinstance(ranged.schema[f"_sv{i}"].dataType, T.IntegralType):
            local[f"_sl{i}"] = _sum_behind(v, cell, a.frame)
        else:
            local[f"_sl{i}"] = _AGG[a.fn](v).over(back.rowsBetween(*_FRAMES[_MIRROR[a.frame]]))
    windowed = ranged.withColumns(local)

    # first / last key of every range partition: the only cells that can span partitions
    kstruct = F.struct(*[F.col(k) for k in keys])
    bounds = ranged.groupBy("_pid").agg(F.min(kstruct).alias("lo"), F.max(kstruct).alias("hi"))
    bcells = (bounds.select("_pid", *[F.col(f"lo.{k}").alias(k) for k in keys])
              .unionByName(bounds.select("_pid", *[F.col(f"hi.{k}").alias(k) for k in keys]))
              .distinct())
    totals = (null_safe_join(ranged, F.broadcast(bcells), ["_pid", *keys])  # <= 2n cells
              .groupBy("_pid", *keys)
              .agg(*[_AGG[a.fn](f"_sv{i}").alias(f"_st{i}") for i, a in enumerate(accs)]))
    across = Window.partitionBy(*keys).orderBy("_pid")
    carry_cols = {}
    for i, a in enumerate(accs):
        behind, ahead = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
        at = lambda frame, a=a, i=i: _AGG[a.fn](f"_st{i}").over(across.rowsBetween(*frame))
        if a.frame != "all":
            carry_cols[f"_sc{i}"] = at(behind if a.frame in ("upto", "before") else ahead)
        elif a.fn == "sum":
            carry_cols[f"_sc{i}"] = F.coalesce(at(behind) + at(ahead), at(behind), at(ahead))
        else:
            carry_cols[f"_sc{i}"] = at(_FRAMES["all"])
    carry = totals.withColumns(carry_cols).select("_pid", *keys, *carry_cols.keys())

    out = null_safe_join(windowed, F.broadcast(carry), ["_pid", *keys], "left")
    res = {}
    for i, a in enumerate(accs):
        lc, cc = F.col(f"_sl{i}"), F.col(f"_sc{i}")
        if a.fn == "sum":
            res[a.out] = F.when(lc.isNull() & cc.isNull(), F.lit(None)).otherwise(
                F.coalesce(lc, F.lit(0)) + F.coalesce(cc, F.lit(0)))
        elif a.fn == "max":
            res[a.out] = F.greatest(lc, cc)
        else:
            res[a.out] = F.least(lc, cc)
    helper = ["_pid", *vals.keys(), *local.keys(), *carry_cols.keys()]
    return out.withColumns(res).drop(*helper)


def row_index(df: DataFrame, keys: list[str], order: list, out: str = "row_index",
              num_partitions: int | None = None) -> DataFrame:
    """0-based dense position of every row inside its ``keys`` group (skew-safe)."""
    r = scan(df, keys, order, [Acc(out, "sum", F.lit(1), "before")], num_partitions)
    return r.withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long"))
