"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, ``shingle`` consecutive ones
joined by a space (fewer words: all of them; none: fingerprint zero), XXH64 with seed 42; a bit
is set if it is set in over half the shingles' hashes. Fingerprints link at ``radius`` or fewer differing bits.

Equal fingerprints become one first, so copies cost nothing. The 64 bits are cut into ``radius + 2`` bands; two
linked fingerprints differ in at most ``radius`` of them, so they agree on at least two: fingerprints meet under
every pair of bands, and no link is lost. A key with more than ``cell`` fingerprints is split into cells, each a pair of salted
parts, so that all its pairs are still compared. Inside a cell the
comparison is bit-sliced: bit planes are stored vertically, 64 fingerprints to a word, the differing
bits of three planes at a time go through a carry-save adder into bitwise counters, and a tile is abandoned as soon as
all its counters are past the radius. A cell returns a spanning star per linked group, not its pairs.

Defined cases: null text has no words (fingerprint zero, linked like any other); repeated rows
have the same fingerprint; null ids are ignored for ``component_id``, which is null only if a whole component
has none; an empty table gives an empty result; ``near_dedup`` keeps all columns.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorscan.llm import blocks as B
from authorscan.llm.components import components

U64 = np.uint64
SEED = 42
CELL = 2048
TILE = 256
ONES = U64(0x0101010101010101)


# ------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [xxhash.xxh64_intdigest(joined[i:j - 1], SEED) for i, j in zip(starts, ends[shingle - 1:])]  # noqa: B905


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document, the bits set in over half of its hashes."""
    out = np.zeros(sizes.size, U64)
    some = np.flatnonzero(sizes)
    if not some.size:
        return out
    n = sizes[some]
    begin = np.cumsum(n) - n
    parts = -(-n // 255)  # byte lanes count up to 255 hashes at once
    first_part = np.cumsum(parts) - parts
    at = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first_part, parts))
    res = np.zeros(some.size, U64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> U64(k)) & ONES, at)
        count = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_part, axis=0)
        for byte in range(8):
            res |= (2 * count[:, byte] > n).astype(U64) << U64(8 * byte + k)
    out[some] = res
    return out


def fingerprints_of(texts: list[bytes], shingle: int) -> np.ndarray:
    """Fingerprints of ``texts``; a bounded number of hashes is held at once, beside one text's."""
    fps, got, sizes, held = [np.zeros(0, U64)], [], [], 0

    def flush():
        h = np.fromiter((x for g in got for x in g), U64, sum(sizes))
        return majority(h, np.array(sizes, np.int64))

    for x in texts:
        got.append(shingle_hashes(x, shingle))
        sizes.append(len(got[-1]))
        held += sizes[-1]
        if held > 200_000:
            fps.append(flush())
            got, sizes, held = [], [], 0
    fps.append(flush())
    return np.concatenate(fps)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``docs`` (its columns but text) with ``fp``, the fingerprint as a long."""
    keep = [c for c in docs.columns if c != "text"]
    schema = docs.drop("text").schema.add("fp", "long")
    out = B.arrow_schema(schema)

    def run(it):
        for rb in it:
            fps = fingerprints_of(B.texts_of(pa.Table.from_batches([rb])), shingle)
            cols = [rb.column(rb.schema.get_field_index(c)) for c in keep]
            yield from pa.table([*cols, fps.view(np.int64)], schema=out).to_batches()

    return docs.mapInArrow(run, schema)


# ------------------------------------------------------ bit-sliced comparison


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of bits, one lane for each value, packed to words."""
    lanes = -(-values.size // 64) * 64
    v = np.zeros(lanes, U64)
    v[:values.size] = values
    bits = np.unpackbits(v.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(U64)


def within(queries: np.ndarray, vertical: np.ndarray, radius: int) -> np.ndarray:
    """Bit matrix (query, lane): the distance is at most ``radius``."""
    width = radius.bit_length()
    shape = (queries.size, vertical.shape[1])
    start = (1 << width) - 1 - radius  # the counters overflow at radius + 1
    counter = [np.full(shape, ~U64(0) if start >> i & 1 else U64(0)) for i in range(width)]
    over = np.zeros(shape, U64)

    def add(d, i):
        for c in counter[i:]:
            carry = c & d
            c ^= d
            d = carry
        np.bitwise_or(over, d, out=over)

    def differ(b):
        flip = U64(0) - ((queries >> U64(b)) & U64(1))
        return vertical[b][None, :] ^ flip[:, None]

    for b in range(0, 63, 3):
        x, y, z = differ(b), differ(b + 1), differ(b + 2)
        xy = x ^ y
        add(xy ^ z, 0)  # carry-save: three planes to a sum and a carry
        add((x & y) | (z & xy), 1)
        if b >= 12 and (over == ~U64(0)).all():
            return np.zeros((queries.size, shape[1] * 64), bool)
    add(differ(63), 0)
    bits = np.unpackbits((~over).view(np.uint8).reshape(queries.size, -1), axis=1, bitorder="little")
    return bits.astype(bool)


def stars(values: np.ndarray, cell: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest-indexed value linked to it through its cell). ``cell`` is sorted."""
    label = np.arange(values.size)
    edges = np.r_[B.firsts(cell), values.size]
    at = 0
    while at < edges.size - 1:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + TILE, "right")) - 1)
        i, j = int(edges[at]), int(edges[to])
        at = to
        if j - i < 2:
            continue
        vertical, lanes = planes(values[i:j]), label[i:j]
        for q in range(i, j, TILE):
            hit = within(values[q:min(q + TILE, j)], vertical, radius)[:, :j - i]
            if not hit.any():
                continue
            hit &= cell[q:min(q + TILE, j), None] == cell[None, i:j]
            for k in np.flatnonzero(hit.sum(axis=1) > 1):
                old = np.unique(lanes[hit[k]])
                if old.size > 1:
                    lanes[np.isin(lanes, old)] = old[0]
    moved = np.flatnonzero(label != np.arange(values.size))
    return values[moved], values[label[moved]]


def links(fps: DataFrame, radius: int = 4, cell: int = CELL) -> DataFrame:
    """(a, b) spanning all links between the distinct fingerprints ``fps(fp)``."""
    bands = radius + 2
    cuts = [64 * i // bands for i in range(bands + 1)]
    part = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    keys = [F.struct(F.lit(n).alias("pair"), part[i].alias("x"), part[j].alias("y"))
            for n, (i, j) in enumerate(combinations(range(bands), 2))]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.pair", "k.x", "k.y")
    key = ["pair", "x", "y"]
    sizes = store_sizes(keyed.groupBy(*key).count().where("count > 1"), cell)
    salted = keyed.join(sizes, key).withColumn("s", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    other = F.explode(F.expr("if(n = 1, array(0), filter(sequence(0, n - 1), i -> i <> s))"))
    cells = (salted.withColumn("o", other).groupBy(*key, F.least("s", "o").alias("s"), F.greatest("s", "o").alias("o"))
             .agg(F.collect_list("fp").alias("fps")))  # at most about 2 * cell

    def compare(it):
        for rb in it:
            lists = rb.column(0)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
            a, b = stars(values, np.repeat(np.arange(sizes.size), sizes), radius)
            yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cells.select("fps").mapInArrow(compare, "a long, b long")


def store_sizes(counts: DataFrame, cell: int) -> DataFrame:
    """Keys with the number of salted parts their fingerprints go to."""
    return B.store(counts.withColumn("n", F.ceil(F.col("count") / cell).cast("int")).drop("count"))


def groups(rows: DataFrame, radius: int = 4) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with ``root``, the least fingerprint of the component, and ``component_id``."""
    distinct = B.store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), radius))
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    of = B.store(of)
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = B.store(of.select("fp", "root").join(ids, "root"))
    return rows.join(named, "fp")


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``."""
    rows = B.store(fingerprints(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), shingle))
    return groups(rows, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, shingle: int = 4, radius: int = 4, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest doc_id (null ids last); no text is shuffled."""
    sealed = B.seal(docs, block_bytes, bucketed=True)

    def rows_of(block, t):
        fps = fingerprints_of(B.texts_of(t), shingle).view(np.int64)
        ids = t.column("doc_id").combine_chunks().cast(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(fps.size, block)), pa.array(np.arange(fps.size, dtype=np.int32)), ids, pa.array(fps)],
                                         names=["block", "nth", "doc_id", "fp"])

    found = groups(B.store(B.map_blocks(sealed, rows_of, "block long, nth int, doc_id long, fp long")), radius)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("block"), F.col("nth")))
    keep = B.store(found.groupBy("root").agg(first.alias("k")).select("k.block", "k.nth"))
    return B.pick_rows(sealed, keep, docs.schema)
