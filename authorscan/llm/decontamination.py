"""Benchmark decontamination over a distributed positional inverted index.

The index: documents are gathered into segments of a few MB of text; a segment stores its terms (hashes of the
words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased) with counts, and every term's
posting list of word positions, written once under ``spark.checkpoint.dir``. Every token of every whole text is in it.

A query is a window of ``window`` consecutive words of a benchmark item (an item of fewer, but not none, is one
window). Its terms are taken from the rarest in the whole corpus to the most common; the rarest
one's postings, moved back by its offset in the window, are the candidates, and each further list, moved by its own
offset, is intersected with what is left. What survives all lists is an exact phrase match; what has
each term within ``slop`` words of the rarest term's position is a proximity match of the item.

The benchmark's distinct texts go to the tasks in blocks of ``query_bytes`` by hash of the text (one block here), so it
may be of any size and hold any number of copies: what is sent at once is bounded but for a single longer text, and every block
meets every segment. Equal windows of a block are one query, and candidates are intersected ``CANDIDATES`` at a time, so text of
few repeated words needs no more memory than other text. Item ids never leave Spark: a document's hits name texts, and the
items of each distinct set of texts are joined and digested once.

Defined cases: null texts have no words; a null item_id's windows hit words but it isn't listed among the items;
repeated items count once; repeated rows of ``documents`` are judged each; an empty
benchmark hits nothing; all columns pass unchanged in ``decontaminate``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorscan.llm import blocks as B

U64 = np.uint64
QUERY_BYTES = 4 << 20
CANDIDATES = 1 << 19


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all words."""
    buf, row_starts = B.join_texts([x.lower() for x in texts])
    starts, ends = B.word_spans(buf, B.ALNUM)
    return np.searchsorted(row_starts, starts, "right") - 1, B.word_hashes(buf, starts, ends)


# -------------------------------------------------------------------- index


INDEX = "block long, docs binary, terms binary, postings binary"


def _segment(block: int, t: pa.Table, gap: int) -> dict:
    """Positions of neighbouring documents lie ``gap`` apart at least."""
    row, words = _words(B.texts_of(t))
    position = (np.arange(words.size) + gap * row).astype(np.uint32)
    order = np.argsort(words, kind="stable")
    first = B.firsts(words[order])
    n = np.diff(np.r_[first, words.size]).astype(np.uint32)
    lists = position[order]
    step = lists.copy()
    step[1:] -= lists[:-1]
    step[first] = lists[first]
    ids = t.column("doc_id").combine_chunks().cast(pa.int64())
    return {"block": block,
            "docs": B.pack(ids.fill_null(0).to_numpy(), np.array(ids.is_null().to_numpy(zero_copy_only=False), np.uint8),
                           np.bincount(row, minlength=t.num_rows).astype(np.int64)),
            "terms": B.pack(B.delta(words[order][first]), n), "postings": B.pack(step)}


def build_index(docs: DataFrame, gap: int, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """(block, docs, terms, postings): segments of ``docs``."""
    return B.store(B.gather_blocks(docs, block_bytes, lambda b, t: _segment(b, t, gap), INDEX), "uncompressed")


def index_blocks(sealed: DataFrame, gap: int) -> DataFrame:
    """``build_index`` of sealed documents; a segment has its block's number."""
    out = B.arrow_schema(INDEX)

    def segments(block, t):
        yield pa.RecordBatch.from_pylist([_segment(block, t, gap)], schema=out)

    return B.store(B.map_blocks(sealed, segments, INDEX), "uncompressed")


def _open_terms(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    d, n = B.unpack(data, U64, np.uint32)
    return B.undelta(d), n.astype(np.int64)


def _open_postings(data: bytes, n: np.ndarray) -> np.ndarray:
    """Sorted (term index << 32 | position)."""
    step = B.unpack(data, np.uint32)[0].astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(n) - n
    before = total[first] - step[first] if n.size else total
    return (np.repeat(np.arange(n.size), n) << 32) | (total - np.repeat(before, n))


# ------------------------------------------------------------------ queries


class _Queries:
    """The distinct windows of one block of the benchmark: terms, where each window lies, and the texts that have it."""

    def __init__(self, rows: list, window: int):
        row, words = _words([r["text"].encode() for r in rows])
        n = np.bincount(row, minlength=len(rows))
        begin = np.cumsum(n) - n
        size = np.minimum(n, window)
        some = np.flatnonzero(n)
        count = (n - size + 1)[some]
        text = np.repeat(some, count)
        at = begin[text] + np.arange(text.size) - np.repeat(np.cumsum(count) - count, count)
        same = B.span_hash(words, at, at + size[text])
        _, first, of = np.unique(same, return_index=True, return_inverse=True)
        self.at, self.size = at[first], size[text[first]]
        has = np.unique(np.stack([of, text]), axis=1) if of.size else np.zeros((2, 0), np.int64)
        self.text_of = np.searchsorted(has[0], np.arange(first.size + 1)), np.array([r["t"] for r in rows], np.int64)[has[1]]
        self.number = np.arange(first.size)
        self.terms, self.word = np.unique(words, return_inverse=True)
        self.longest = int(self.size.max(initial=0))

    def texts(self, windows: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, text) of the given (window, row) pairs, each once."""
        begin, of = self.text_of
        w, r = np.unique(np.stack([self.number[windows], rows]), axis=1) if windows.size else (windows, rows)
        n = begin[w + 1] - begin[w]
        i = np.repeat(begin[w] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pairs = np.unique(np.stack([np.repeat(r, n), of[i]]), axis=1) if i.size else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]

    def plan(self, frequency: np.ndarray) -> None:
        """For every window its offsets from the rarest term to the most common (-1: none left)."""
        grid = np.arange(self.longest)[None, :]
        inside = grid < self.size[:, None]
        place = np.minimum(self.at[:, None] + grid, self.word.size - 1)
        term = np.where(inside, self.word[place], -1)
        often = np.where(inside, frequency[term], np.iinfo(np.int64).max)
        order = np.argsort(often, axis=1, kind="stable")
        self.offset = np.where(np.take_along_axis(inside, order, 1), order, -1)
        self.term = np.take_along_axis(term, order, 1)
        found = np.flatnonzero((often > 0).all(axis=1)) if self.longest else np.zeros(0, np.int64)
        for name in ("number", "size", "offset", "term"):
            setattr(self, name, getattr(self, name)[found])


def _matches(q: _Queries, terms: np.ndarray, n: np.ndarray, postings: np.ndarray, slop: int):
    """Batches of (window, first position) of the phrase matches and (window, position) of the proximity matches."""
    if not q.number.size or not terms.size:
        return
    k = np.minimum(np.searchsorted(terms, q.terms), terms.size - 1)
    here = np.where(terms[k] == q.terms, k, -1)
    term = np.where(q.term >= 0, here[q.term], -2)
    live = np.flatnonzero((term != -1).all(axis=1))
    first, ends = np.cumsum(n) - n, np.cumsum(n[term[live, 0]])
    at = 0
    while at < live.size:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
        yield _intersect(q, term, live[at:to], first, n, postings, slop)
        at = to


def _intersect(q, term, live, first, n, postings, slop):
    rarest = term[live, 0]
    count = n[rarest]
    w = np.repeat(live, count)
    i = np.repeat(first[rarest] - (np.cumsum(count) - count), count) + np.arange(w.size)
    p = postings[i] & 0xFFFFFFFF
    exact = np.ones(w.size, bool)
    for j in range(1, q.longest):
        t = term[w, j]
        more = t >= 0
        list_ = np.where(more, t, 0) << 32
        least = list_ | np.maximum(p - slop, 0)
        got = np.searchsorted(postings, least)
        near = postings[np.minimum(got, postings.size - 1)]
        near = ~more | ((got < postings.size) & (near >= least) & (near <= (list_ | (p + slop))))
        to = p + q.offset[w, j] - q.offset[w, 0]
        want = list_ | np.maximum(to, 0)
        got = np.minimum(np.searchsorted(postings, want), postings.size - 1)
        exact &= ~more | ((postings[got] == want) & (to >= 0))
        keep = near | exact
        w, p, exact = w[keep], p[keep], exact[keep]
    return (w[exact], p[exact] - q.offset[w[exact], 0]), (w, p)


HITS = "block long, data binary"


def _hits(index: DataFrame, texts: DataFrame, window: int, slop: int, gap: int) -> DataFrame | None:
    """(block, data): of each segment, the hit words and the (row, text) pairs found for one block of the benchmark."""
    q = _Queries(texts.collect(), window)  # at most about QUERY_BYTES of distinct texts

    def count(it):
        for rb in it:
            total = np.zeros(q.terms.size, np.int64)
            for d in rb.column(0):
                terms, n = _open_terms(d.as_py())
                if terms.size:
                    k = np.minimum(np.searchsorted(terms, q.terms), terms.size - 1)
                    total += np.where(terms[k] == q.terms, n[k], 0)
            t = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"t": t.astype(np.int32), "n": total[t]})

    frequency = np.zeros(q.terms.size, np.int64)
    for r in index.select("terms").mapInArrow(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        frequency[r["t"]] = r["n"]  # one row for each term of this block of the benchmark
    q.plan(frequency)
    if not q.number.size:
        return None

    def find(docs, data, lists):
        _, _, words = B.unpack(docs, np.int64, np.uint8, np.int64)
        ends = np.cumsum(words) + gap * np.arange(words.size)
        terms, n = _open_terms(data)
        none = np.zeros(0, np.int64)
        hit, pairs = none, [(none, none), (none, none)]
        for (w, p), near in _matches(q, terms, n, _open_postings(lists, n), slop):
            size = q.size[w]
            hit = np.union1d(hit, np.repeat(p - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))
            for k, (v, x) in enumerate(((w, p), near)):
                new = q.texts(v, np.searchsorted(ends, x, "right"))
                both = np.unique(np.concatenate([np.stack(pairs[k]), np.stack(new)], axis=1), axis=1)
                pairs[k] = both[0], both[1]
        return hit, pairs

    def match(it):
        for rb in it:
            rows = zip(*(rb.column(c).to_pylist() for c in ("block", "docs", "terms", "postings")), strict=True)
            for block, docs, data, lists in rows:
                hit, pairs = find(docs, data, lists)
                if not pairs[1][0].size:
                    continue
                parts = [B.pack(hit), *(B.pack(*p) for p in pairs)]
                lens = b"".join(len(d).to_bytes(8, "little") + d for d in parts)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "data": pa.array([lens], pa.binary())})

    return index.mapInArrow(match, HITS)


def _open_hits(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for columns in (1, 2, 2):
        n = int.from_bytes(data[at:at + 8], "little")
        out += B.unpack(data[at + 8:at + 8 + n], *[np.int64] * columns)
        at += 8 + n
    return out


def _all_hits(index: DataFrame, texts: DataFrame, window: int, slop: int, gap: int, query_bytes: int) -> DataFrame:
    """``_hits`` of all blocks of the benchmark's distinct ``texts(t, text)``."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // query_bytes)
    hits = index.sparkSession.createDataFrame([], HITS)
    for k in range(n):
        found = _hits(index, texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k), window, slop, gap)
        hits = hits if found is None else hits.unionByName(found)
    return hits


def _texts(benchmark: DataFrame) -> DataFrame:
    distinct = benchmark.select("text").dropna().distinct()
    return B.store(distinct.withColumn("t", F.monotonically_increasing_id()))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 20,
                  block_bytes: int = B.BLOCK_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near_items for each row of ``docs``."""
    gap = 2 * slop + window
    index = build_index(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), gap, block_bytes)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    texts = _texts(items)
    hits = _all_hits(index, texts, window, slop, gap, query_bytes)

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty.empty_table()
        doc_id, null, words = B.unpack(left.column("docs")[0].as_py(), np.int64, np.uint8, np.int64)
        ends = np.cumsum(words) + gap * np.arange(words.size)
        got = [_open_hits(d) for d in right.column("data").to_pylist()]
        hit = np.unique(np.concatenate([np.zeros(0, np.int64), *(g[0] for g in got)]))

        def lists(k):
            pairs = np.concatenate([np.zeros((2, 0), np.int64), *(np.stack(g[k:k + 2]) for g in got)], axis=1)
            row, text = np.unique(pairs, axis=1) if pairs.size else pairs
            return pa.ListArray.from_arrays(np.searchsorted(row, np.arange(words.size + 1)).astype(np.int32), pa.array(text, pa.int64()))

        return pa.table({"doc_id": pa.array(doc_id, pa.int64(), mask=null.astype(bool)), "n_words": words,
                         "n_hit": np.bincount(np.searchsorted(ends, hit, "right"), minlength=words.size).astype(np.int64),
                         "exact": lists(1), "near": lists(3)}).cast(empty)

    schema = "doc_id long, n_words long, n_hit long, exact array<long>, near array<long>"
    empty = B.arrow_schema(schema)
    found = B.store(index.select("block", "docs").groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(rows, schema))

    touched = found.where(F.size("near") > 0)  # every phrase match is a proximity match
    sets = touched.select(F.col("exact").alias("texts")).union(touched.select("near")).distinct()
    ids = items.join(texts, "text").where("item_id IS NOT NULL").select("t", "item_id").distinct()
    listed = sets.select("texts", F.explode("texts").alias("t")).join(ids, "t").groupBy("texts").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))  # the ids that the digest of one document is of
    digests = B.store(listed.select("texts", F.size("items").cast("long").alias("n"), F.sha2(F.concat_ws(",", "items"), 256).alias("sha")))
    nothing = F.sha2(F.lit(""), 256)
    exact, near = (digests.select(F.col("texts").alias(c), F.col("n").alias(f"n_{c}"), F.col("sha").alias(f"sha_{c}")) for c in ("exact", "near"))
    some = touched.join(exact, "exact", "left").join(near, "near", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_items"), F.coalesce("sha_exact", nothing).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near_items"))
    zero = F.lit(0).cast("long")
    clean = found.where(F.size("near") == 0).select("doc_id", "n_words", "n_hit", zero.alias("n_items"), nothing.alias("items_sha256"),
                                                    F.lit(False).alias("contaminated"), zero.alias("n_near_items"))
    return clean.unionByName(some)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 20, block_bytes: int = B.BLOCK_BYTES,
                  query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``docs`` with all columns, without the rows that hold a benchmark window; no text is shuffled."""
    gap = 2 * slop + window
    sealed = B.seal(docs, block_bytes, bucketed=True)
    index = index_blocks(sealed, gap)
    hits = _all_hits(index, _texts(benchmark), window, slop, gap, query_bytes)

    def bad(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return none.empty_table()
        _, _, words = B.unpack(left.column("docs")[0].as_py(), np.int64, np.uint8, np.int64)
        ends = np.cumsum(words) + gap * np.arange(words.size)
        hit = [_open_hits(d)[0] for d in right.column("data").to_pylist()]
        nth = np.unique(np.searchsorted(ends, np.concatenate([np.zeros(0, np.int64), *hit]), "right"))
        return pa.table({"block": np.full(nth.size, left.column("block")[0].as_py()), "nth": nth.astype(np.int32)}, schema=none)

    none = B.arrow_schema("block long, nth int")
    rows = index.select("block", "docs").groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(bad, "block long, nth int")
    return B.pick_rows(sealed, B.store(rows), docs.schema, keep=False)
