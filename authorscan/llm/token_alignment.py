"""Cross-tokenizer alignment by products of sparse incidence matrices.

For a run of texts, matrix A has a row for each token occurrence of the first tokenizer and a column for each byte, with a
one where the token covers the byte; matrix B is the same for the second tokenizer. Texts follow one another, so both are
block-diagonal. They are compressed sparse rows (CSR) built by hand, and the overlap links are the non-zeros of A Bᵀ, made row by
row after Gustavson: each non-zero of a row picks a row of Bᵀ, and equal columns are summed, which gives the number
of shared bytes. Byte offsets where tokens of both end cut them into groups; the product of the two group incidences
links tokens of one group. That product is a dense block for each group, so it is kept by its factors, and only its row
sizes are computed (its symbolic phase). Rows are multiplied in slabs, so memory doesn't grow with a text's length.

Documents are gathered into blocks that are tokenized once; a block stores its links as numbers of its distinct id pairs. The corpus-wide
count of an id pair is a Spark aggregation over the blocks' pre-summed pairs; counts go back to the blocks that hold the pair by
a join, one row for each block and distinct pair, and a block finishes its documents by a cogroup. No text moves, and no task
gathers a pair's documents.

Defined cases: a null or empty text, or one whose joined token bytes differ from space + text for either tokenizer, has no
tokens: all numbers are 0 and ``groups_sha256`` is ''. Repeated rows are aligned and counted each; null ids pass through; an empty table
gives an empty result; other columns are ignored. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authorscan.llm import blocks as B
from authorscan.llm.tokens import byte_tokens, piece_tokens

SLAB = 1 << 21  # non-zeros multiplied at once
RUN_BYTES = 1 << 20  # text aligned at once, a longer one by itself


# ------------------------------------------------------------------ matrices


@dataclass
class Csr:
    """A sparse matrix of ones or counts: row r holds ``indices[indptr[r]:indptr[r + 1]]``."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    @classmethod
    def spans(cls, lengths: np.ndarray) -> Csr:
        """Row r covers the next ``lengths[r]`` columns."""
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if ends.size else 0
        return cls(np.r_[0, ends], np.arange(total), total)

    @classmethod
    def choices(cls, column: np.ndarray, columns: int) -> Csr:
        """Row r has one non-zero, at ``column[r]``."""
        return cls(np.arange(column.size + 1), column, columns)

    @property
    def rows(self) -> int:
        return self.indptr.size - 1

    def transposed(self) -> Csr:
        row = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        if (self.indices[1:] < self.indices[:-1]).any():
            row = row[np.argsort(self.indices, kind="stable")]
        return Csr(np.r_[0, np.cumsum(np.bincount(self.indices, minlength=self.columns))], row, self.rows)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Symbolic phase: non-zeros of ``b`` that each row of ``a`` picks."""
    picked = np.r_[0, np.cumsum(np.diff(b.indptr)[a.indices])]
    return picked[a.indptr[1:]] - picked[a.indptr[:-1]]


def product(a: Csr, b: Csr, slab: int = SLAB) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson: (row, column, value) of the non-zeros of a b, by rows, a slab of rows at a time."""
    work = np.r_[0, np.cumsum(product_sizes(a, b))]
    r = 0
    while r < a.rows:
        to = max(r + 1, int(np.searchsorted(work, work[r] + slab, "right")) - 1)
        pick = a.indices[a.indptr[r]:a.indptr[to]]
        count = b.indptr[pick + 1] - b.indptr[pick]
        row = np.repeat(np.repeat(np.arange(r, to), np.diff(a.indptr[r:to + 1])), count)
        at = np.repeat(b.indptr[pick] - (np.cumsum(count) - count), count) + np.arange(row.size)
        key = row * b.columns + b.indices[at]
        if key.size and (key[1:] < key[:-1]).any():
            key.sort()
        first = B.firsts(key)
        yield key[first] // max(b.columns, 1), key[first] % max(b.columns, 1), np.diff(np.r_[first, key.size])
        r = to


# ----------------------------------------------------------------- alignment


@dataclass
class Aligned:
    """Tokens, links and groups of a run of texts; tokens are numbered through the run."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # (A token, B token, shared bytes)
    shared: np.ndarray  # group links of every A token


def align(texts: list[str | None], path_a: str, path_b: str) -> Aligned:
    a, b = byte_tokens(path_a), piece_tokens(path_b)
    ids: tuple[list, list] = ([], [])
    for text in texts:
        got = [], []
        if text:
            y = b.ids(text)
            x = a.ids(" " + text) if b.covers(text, y) else []
            if x and a.covers(" " + text, x):
                got = x, y
        for of, new in zip(ids, got, strict=True):
            of.append(np.array(new, np.int64))
    a_ids, b_ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ids)
    a_doc, b_doc = (np.repeat(np.arange(len(texts)), [i.size for i in x]) for x in ids)
    a_bytes, b_bytes = Csr.spans(a.length[a_ids]), Csr.spans(b.length[b_ids])
    links = list(product(a_bytes, b_bytes.transposed()))
    a_ends, b_ends = a_bytes.indptr[1:], b_bytes.indptr[1:]
    ends = np.zeros(a_bytes.columns + 1, np.int8)
    ends[a_ends] = 1
    ends[b_ends] += 1  # 2 where both end; a document's last token ends in both
    before = np.cumsum(ends == 2)
    a_group, b_group = before[a_ends] - (ends[a_ends] == 2), before[b_ends] - (ends[b_ends] == 2)
    n = int(before[-1])
    shared = product_sizes(Csr.choices(a_group, n), Csr.choices(b_group, n).transposed())
    return Aligned(a_ids, b_ids, a_doc, b_doc, a_group, b_group, links, shared)


@functools.cache
def _printed(ids: int) -> list[bytes]:
    """The decimal form of every id below ``ids`` before a comma, a bar and a semicolon."""
    return [b"%d%c" % (i, c) for i in range(ids) for c in b",|;"]


def group_texts(x: Aligned, docs: int) -> list[bytes]:
    """Of every document its groups as ``a1,a2|b1;a3|b2,b3``."""
    na, nb = x.a_ids.size, x.b_ids.size
    at = np.r_[np.arange(na) + np.searchsorted(x.b_group, x.a_group), np.arange(nb) + np.searchsorted(x.a_group, x.b_group, "right")]
    code, doc = np.empty(na + nb, np.int64), np.empty(na + nb, np.int64)
    last_a, last_b = (np.r_[g[1:] != g[:-1], True][:g.size] for g in (x.a_group, x.b_group))
    code[at] = np.r_[3 * x.a_ids + last_a, 3 * x.b_ids + 2 * last_b]
    doc[at] = np.r_[x.a_doc, x.b_doc]
    ends = np.searchsorted(doc, np.arange(docs + 1))
    word, of = _printed(1 << (int(code.max(initial=0)) // 3).bit_length()).__getitem__, code.tolist()
    return [b"".join(map(word, of[i:j]))[:-1] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about RUN_BYTES."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 16
        if size >= RUN_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


# -------------------------------------------------------------------- outputs


def overlap_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a_index, b_index, a_id, b_id, n_bytes: one row for each overlap link."""

    def rows(ids, x):
        a_first, b_first = (np.searchsorted(d, np.arange(len(ids))) for d in (x.a_doc, x.b_doc))
        for i, j, n in x.links:
            d = x.a_doc[i]
            yield [pa.array(ids).take(pa.array(d)), i - a_first[d], j - b_first[d], x.a_ids[i], x.b_ids[j], n]

    return _emit(docs, path_a, path_b, rows, "doc_id long, a_index long, b_index long, a_id long, b_id long, n_bytes long")


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, group, side ('a' or 'b'), index, id: one row for each token, with its group; tokens of one group are linked."""

    def rows(ids, x):
        for side, doc, group, token in (("a", x.a_doc, x.a_group, x.a_ids), ("b", x.b_doc, x.b_group, x.b_ids)):
            first = np.searchsorted(doc, np.arange(len(ids)))
            base = np.r_[x.a_group, 0][np.searchsorted(x.a_doc, np.arange(len(ids)))]  # a document's first group
            yield [pa.array(ids).take(pa.array(doc)), group - base[doc], pa.array([side] * doc.size), np.arange(doc.size) - first[doc], token]

    return _emit(docs, path_a, path_b, rows, "doc_id long, group long, side string, index long, id long")


def _emit(docs: DataFrame, path_a: str, path_b: str, rows: Callable, schema: str) -> DataFrame:
    out = B.arrow_schema(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            ids, texts = rb.column("doc_id").to_pylist(), rb.column("text").to_pylist()
            for i, j in runs(texts):
                for cols in rows(pa.array(ids[i:j], pa.int64()), align(texts[i:j], path_a, path_b)):
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


# ----------------------------------------------------------------- whole table


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """(block, docs, groups, pairs, links): every block's document numbers, group digests, distinct id pairs, and a pair number for each link."""

    def emit(block: int, t: pa.Table) -> dict:
        texts = t.column("text").to_pylist()
        width = piece_tokens(path_b).length.size
        numbers, digests, keys = [], [], []
        for i, j in runs(texts):
            x, n = align(texts[i:j], path_a, path_b), j - i
            first = np.searchsorted(x.a_doc, np.arange(n + 1))
            last_group = np.r_[0, x.a_group + 1]
            n_groups = last_group[first[1:]] - last_group[first[:-1]]
            n_groups[first[1:] == first[:-1]] = 0
            n_links = sum((np.bincount(x.a_doc[a], minlength=n) for a, _, _ in x.links), np.zeros(n, np.int64))
            shared = np.r_[0, np.cumsum(x.shared)]
            numbers.append((np.diff(first), np.bincount(x.b_doc, minlength=n), n_groups, n_links, shared[first[1:]] - shared[first[:-1]]))
            digests += [hashlib.sha256(g).digest() if g else b"\0" * 32 for g in group_texts(x, n)]
            keys += [x.a_ids[a] * width + x.b_ids[b] for a, b, _ in x.links]
        ids = t.column("doc_id").combine_chunks()
        pairs, of, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*numbers, strict=True)]
        return {"block": block, "docs": B.pack(ids.fill_null(0).to_numpy(), np.array(ids.is_null().to_numpy(zero_copy_only=False), np.uint8), *columns),
                "groups": b"".join(digests), "pairs": B.pack(B.delta(pairs), count.astype(np.int64)), "links": B.pack(of.astype(np.uint32))}

    schema = "block long, docs binary, groups binary, pairs binary, links binary"
    blocks = B.gather_blocks(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), block_bytes, emit, schema)
    return B.store_by(blocks, "block", B.bucket_number(B.text_bytes(docs)))


def _open_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, count = B.unpack(data, np.int64, np.int64)
    return B.undelta(steps), count


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): corpus-wide links of each id pair, and whether no pair of the same B id has more. A pair is a * width + b."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def merged():
            pair = np.concatenate([p for p, _ in held])
            n = np.concatenate([c for _, c in held])
            order = np.argsort(pair, kind="stable")
            first = B.firsts(pair[order])
            return pair[order][first], np.add.reduceat(n[order], first) if first.size else n

        for rb in it:
            for data in rb.column(0):
                held.append(_open_pairs(data.as_py()))
                if sum(p.size for p, _ in held) > 1 << 21:
                    held = [merged()]
                    if held[0][0].size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], names=["pair", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], names=["pair", "n"])

    summed = blocks.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair") % width)  # as many rows at most as the first vocabulary has ids
    return B.store(summed.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best")))


def alignment(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_group_links for each row of ``docs``."""
    width = piece_tokens(path_b).length.size
    blocks = aligned_blocks(docs, path_a, path_b, block_bytes)
    counts = pair_counts(blocks, width)

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for block, data in zip(rb.column("block").to_pylist(), rb.column("pairs"), strict=True):
                pair, _ = _open_pairs(data.as_py())
                yield pa.RecordBatch.from_pydict({"block": np.full(pair.size, block), "nth": np.arange(pair.size, dtype=np.int32), "pair": pair})

    asked = blocks.select("block", "pairs").mapInArrow(ask, "block long, nth int, pair long")
    answers = asked.join(counts, "pair").select("block", "nth", "n", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty.empty_table()
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        doc_id, null, n_a, n_b, n_groups, n_links, n_group_links = B.unpack(row["docs"], np.int64, np.uint8, *[np.int64] * 5)
        link = B.unpack(row["links"], np.uint32)[0]
        order = np.argsort(right.column("nth").to_numpy())
        n, best = right.column("n").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        ends = np.cumsum(n_links)
        total, top = np.r_[0, np.cumsum(n[link])], np.r_[0, np.cumsum(best[link])]
        return pa.table({
            "doc_id": pa.array(doc_id, pa.int64(), mask=null.astype(bool)), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
            "n_best": (top[ends] - top[ends - n_links]).astype(np.int64), "count_sum": total[ends] - total[ends - n_links],
            "groups_sha256": [row["groups"][32 * i:32 * i + 32].hex() if k else "" for i, k in enumerate(n_a.tolist())],
            "n_group_links": n_group_links})

    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
              "n_group_links long")
    empty = B.arrow_schema(schema)
    left = blocks.select("block", "docs", "groups", "links").groupBy("block")
    return left.cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
