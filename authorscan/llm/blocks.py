"""Blocks of documents and packed exchanges.

Several operators here ask of every n-gram, window or line variant of a corpus
whether it stands elsewhere too. One shuffled row per window costs more than the
corpus itself, so the rows shuffled are packed arrays:

* ``seal`` gathers whole documents into blocks of a few MB of text (one row a
  block) and writes them once under ``spark.checkpoint.dir``. A block's content
  is fixed from then on, whatever executor is lost later.
* a pass maps each block to one sorted, delta-coded array of 64-bit hashes per
  hash partition ``p`` (``split_sorted``, ``pack``); Spark shuffles by ``p``.
  A hash occurs once per block, so a passage in a third of all documents is one
  entry per block: hot keys are pre-aggregated before the shuffle.
* a reducer sees all entries of one ``p`` (about 16 MB of text's worth, see
  ``partitions``) and answers each block; answers meet their block again by a
  cogroup on the block id (one block, its answers).

Entries are blocks x partitions. From ``GROWS_FROM`` bytes of text on, blocks and partitions both grow with the square
root of the table (``grown``), so entries grow in proportion to the table and keep their size; a task's memory grows
with the root: ten times for a hundred times the text.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from authorscan.session import checkpoint_dir, note_stage

BLOCK_BYTES = 4 << 20
PART_BYTES = 16 << 20
GROWS_FROM = 64 << 30
MIN_PARTS = 64
MAX_BUCKETS = 100_000  # what Spark allows

U64 = np.uint64
_BASE = 0x9E6C63D0876A9A47  # any odd 64-bit number
_INV = pow(_BASE, -1, 1 << 64)

PACKED = "block long, p int, data binary"


def store(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    note_stage(path)
    return spark.read.schema(df.schema).parquet(path)


def store_by(df: DataFrame, key: str, n: int) -> DataFrame:
    """``store`` in ``n`` hash buckets of ``key``: a cogroup on ``key`` reads them without a shuffle of ``df``."""
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.format("parquet").option("path", path).option("compression", "uncompressed").bucketBy(n, key).saveAsTable(name)
    note_stage(path, name)
    return spark.table(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# ------------------------------------------------------------------ packing


@functools.cache
def _codec():
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as zstd-compressed byte planes."""
    planes = [a.view(np.uint8).reshape(a.size, a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays)]
    return _codec()[0].compress(b"".join(planes))


def unpack(data: bytes, *dtypes) -> list[np.ndarray]:
    raw = np.frombuffer(_codec()[1].decompress(data), np.uint8)
    n, at, out = raw.size // sum(np.dtype(d).itemsize for d in dtypes), 0, []
    for d in map(np.dtype, dtypes):
        out.append(np.ascontiguousarray(raw[at:at + n * d.itemsize].reshape(d.itemsize, n).T).view(d).reshape(n))
        at += n * d.itemsize
    return out


def delta(a: np.ndarray) -> np.ndarray:
    d = a.copy()
    d[1:] -= a[:-1]
    return d


def undelta(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=d.dtype)


def split_sorted(h: np.ndarray, parts: int):
    """(p, slice) of a sorted uint64 array by its top bits; ``parts`` is a power of two."""
    edges = np.searchsorted(h, np.arange(1, parts, dtype=U64) << U64(65 - parts.bit_length()))
    edges = [0, *edges.tolist(), h.size]
    for p in range(parts):
        if edges[p] < edges[p + 1]:
            yield p, slice(edges[p], edges[p + 1])


def firsts(sorted_values: np.ndarray) -> np.ndarray:
    """Index of the first element of every run of equal values."""
    if not sorted_values.size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


# ------------------------------------------------------------------- blocks


def gather_blocks(docs: DataFrame, block_bytes: int, emit, schema: str, text: str = "text") -> DataFrame:
    """Whole rows of ``docs`` gathered up to ``block_bytes`` of text (a longer text is its own block):
    ``emit(block id, table) -> dict`` makes the row of a block."""
    out = arrow_schema(schema)

    def gather(it):
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            got = emit((part << 32) + n, pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_pydict({f.name: pa.array([got[f.name]], f.type) for f in out})

        for rb in it:
            lens = pc.fill_null(pc.binary_length(rb.column(rb.schema.get_field_index(text))), 0)
            ends = np.cumsum(lens.to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            at = 0
            while at < rb.num_rows:
                base = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, base + block_bytes - size, "left")) + 1
                to = min(max(to, at + 1), rb.num_rows)
                held.append(rb.slice(at, to - at))
                size += int(ends[to - 1]) - base
                at = to
                if size >= block_bytes:
                    yield row()
                    n, held, size = n + 1, [], 0
        if held:
            yield row()

    return docs.mapInArrow(gather, schema)


def grown(size: int, total: int) -> int:
    """``size`` bytes, more from ``GROWS_FROM`` bytes of text on, by the square root of ``total``."""
    return size if total <= GROWS_FROM else int(size * (total / GROWS_FROM) ** 0.5)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def seal(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucketed: bool = False) -> DataFrame:
    """(block, bytes, payload): blocks of ``docs`` as compressed Arrow, written once; if ``bucketed``, ``meet_blocks`` doesn't shuffle them."""

    def emit(block, t):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        size = pc.sum(pc.binary_length(t.column("text"))).as_py() or 0
        return {"block": block, "bytes": size + t.num_rows, "payload": sink.getvalue().to_pybytes()}

    total = text_bytes(docs)
    blocks = gather_blocks(docs, grown(block_bytes, total), emit, "block long, bytes long, payload binary")
    return store_by(blocks, "block", bucket_number(total)) if bucketed else store(blocks, "uncompressed")


def bucket_number(total: int) -> int:
    """Buckets for blocks of ``total`` bytes of text: one for each ``PART_BYTES``."""
    return min(max(MIN_PARTS, total // grown(PART_BYTES, total)), MAX_BUCKETS)


def open_block(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def partitions(blocks: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Number of hash partitions: a power of two with about ``part_bytes`` (``grown``) of text for each."""
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    return max(MIN_PARTS, 1 << max(0, (total // grown(part_bytes, total)).bit_length()))


def map_blocks(blocks: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(block id, table) -> iterable of RecordBatch`` over every block."""

    def run(it):
        for rb in it:
            for b, payload in zip(rb.column("block").to_pylist(), rb.column("payload"), strict=True):
                yield from fn(b, open_block(payload.as_py()))

    return blocks.select("block", "payload").mapInArrow(run, schema)


def meet_blocks(blocks: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(block id, table, [(p, data)]) -> RecordBatch / Table`` for every block and its answers."""
    out = arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        got = list(zip(right.column("p").to_pylist(), right.column("data").to_pylist(), strict=True))
        return fn(left.column("block")[0].as_py(), open_block(left.column("payload")[0].as_py()), sorted(got))

    left = blocks.select("block", "payload").groupBy("block")
    return left.cogroup(answers.select("block", "p", "data").groupBy("block")).applyInArrow(run, schema)


def pick_rows(sealed: DataFrame, rows: DataFrame, schema: StructType, keep: bool = True) -> DataFrame:
    """The rows of the documents in ``sealed`` that ``rows(block, nth)`` names, or without ``keep`` all others. Only the numbers move."""
    out = arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        t = open_block(left.column("payload")[0].as_py())
        chosen = np.full(t.num_rows, not keep)
        chosen[right.column("nth").to_numpy()] = keep
        return t.filter(pa.array(chosen)).cast(out)

    left = sealed.select("block", "payload").groupBy("block")
    return left.cogroup(rows.select("block", "nth").groupBy("block")).applyInArrow(run, schema)


def reduce_parts(packed: DataFrame, fn, schema: str = PACKED) -> DataFrame:
    """``fn(p, block ids, datas) -> [(block, data)]`` for each hash partition."""

    def run(t: pa.Table) -> pa.Table:
        p = t.column("p")[0].as_py()
        got = fn(p, t.column("block").to_pylist(), t.column("data").to_pylist())
        return packed_table([(b, p, d) for b, d in got])

    return packed.groupBy("p").applyInArrow(run, schema)


def packed_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, p, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"block": pa.array(b, pa.int64()), "p": pa.array(p, pa.int32()), "data": pa.array(d, pa.binary())})


def packed_batches(rows):
    t = packed_table(list(rows))
    return t.to_batches()


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


# -------------------------------------------------------------------- words

ASCII_SPACE = np.ones(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = False  # words [^\x20\x09-\x0D]+
ALNUM = np.zeros(256, bool)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 256))] = True


def texts_of(t: pa.Table, text: str = "text") -> list[bytes]:
    """UTF-8 of every row's text; null is empty."""
    c = t.column(text)
    if not pa.types.is_binary(c.type):
        c = c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary())
    return [x or b"" for x in c.to_pylist()]


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts between newlines as one byte array, and where each text starts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lens + 1) - lens
    return np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8), starts


def word_spans(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = is_word[buf]
    return np.flatnonzero(m[1:] > m[:-1]) + 1, np.flatnonzero(m[:-1] > m[1:]) + 1


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = sum of values[k] * BASE^k for i <= k < j (mod 2^64)."""
    c = np.zeros(values.size + 1, U64)
    np.multiply(values, powers(_BASE, values.size), out=c[1:])
    return np.add.accumulate(c, out=c)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of values[start:end], the same wherever the span lies."""
    c = prefix_sums(values.astype(U64) + U64(1))
    h = c[ends] - c[starts]
    del c
    h *= powers(_INV, values.size + 1)[starts]
    return mix(h ^ ((ends - starts).astype(U64) * U64(0xA24BAED4963EE407)))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(buf, starts, ends)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive word hashes."""
    n = words.size - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for j in range(length):
        h *= U64(_BASE)
        h += words[j:j + n]
    return mix(h)
