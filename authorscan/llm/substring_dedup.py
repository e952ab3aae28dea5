"""Substring dedup by level-wise doubling.

A window is ``window`` consecutive words of one document. A word goes if a window
that covers it also starts in a document with a smaller id; windows are judged
on the input. The windows are found level by level: lengths double (the last
step stops at ``window``), and a window enters a level only if the two windows of
the level below that make it up are repeated there, so only the lowest level
sees the whole corpus, and it sends 40-bit hashes alone. Candidates of the last level
are compared by 64-bit hashes together with the smallest document id they start in. It ends
early when no candidate survives a level.

Defined cases: null or empty text has no words and keeps the empty string; documents
with the same id don't remove each other's words (an id is not smaller than
itself), whichever rows repeat; a row with a null id keeps all its words and removes none;
columns besides id and text are ignored by ``substring_dedup`` and kept as they are by
``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from authorscan.llm import blocks as B

U64 = np.uint64
LOW = U64(24)  # lower levels send the top 40 bits


def levels(window: int, shortest: int = 7) -> list[int]:
    """Window lengths from the bottom up: each at most twice the one before, the last ``window``."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Words:
    """The words of one block: bytes, spans, hashes and the row each belongs to."""

    def __init__(self, t: pa.Table):
        self.texts = B.texts_of(t)
        self.buf, self.row_starts = B.join_texts(self.texts)
        self.starts, self.ends = B.word_spans(self.buf, B.ASCII_SPACE)
        self.row = np.searchsorted(self.row_starts, self.starts, "right") - 1
        self.hash = B.word_hashes(self.buf, self.starts, self.ends)
        ids = t.column("doc_id")
        self.null = np.array(ids.is_null().to_numpy(), bool)
        self.id = ids.fill_null(0).to_numpy().astype(np.int64)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of the windows inside one row with an id, and their hashes."""
        n = self.hash.size - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        inside = (self.row[:n] == self.row[length - 1:]) & ~self.null[self.row[:n]]
        at = np.flatnonzero(inside)
        return at, B.window_hashes(self.hash, length)[at]


def _candidates(w: _Words, length: int, below: int, known: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` whose two covering windows of ``below`` are among the repeated ones."""
    repeated = _values(known)
    at, h = w.windows(below)
    ok = np.zeros(w.hash.size + length, bool)
    ok[at[np.isin(h >> LOW, repeated)]] = True
    at, h = w.windows(length)
    keep = ok[at] & ok[at + (length - below)]
    return at[keep], h[keep]


def _values(answers: list[tuple[int, bytes]]) -> np.ndarray:
    got = [B.undelta(B.unpack(d, U64)[0]) for _, d in answers]
    return np.concatenate(got) if got else np.zeros(0, U64)


def _probe(w: _Words, block: int, at: np.ndarray, h: np.ndarray, parts: int) -> pa.Table:
    """The block's distinct hashes (40 bits), with a flag where two of its documents have one."""
    h = h >> LOW << LOW
    order = np.argsort(h, kind="stable")
    h, ids = h[order], w.id[w.row[at[order]]]
    first = B.firsts(h)
    low, high = (f.reduceat(ids, first) if first.size else ids for f in (np.minimum, np.maximum))
    multi, h = (low != high).astype(np.uint8), h[first]
    return B.packed_table([(block, p, B.pack(B.delta(h[s] >> LOW), multi[s])) for p, s in B.split_sorted(h, parts)])


def _repeated(p: int, ids: list[int], datas: list[bytes]):
    """To each block, those of its hashes that two documents have."""
    got = [B.unpack(d, U64, np.uint8) for d in datas]
    mine = [B.undelta(d) for d, _ in got]
    every = np.concatenate(mine + [m[f > 0] for m, (_, f) in zip(mine, got, strict=True)])
    every.sort()
    first = B.firsts(every)
    twice = every[first][np.diff(np.r_[first, every.size]) > 1]
    for b, m in zip(ids, mine, strict=True):
        if (hit := m[np.isin(m, twice, assume_unique=True)]).size:
            yield b, B.pack(B.delta(hit))


def _owners(w: _Words, block: int, at: np.ndarray, h: np.ndarray, parts: int) -> pa.Table:
    """Each distinct candidate of the block with the smallest id it starts in."""
    order = np.argsort(h, kind="stable")
    h, ids = h[order], w.id[w.row[at[order]]]
    first = B.firsts(h)
    low = np.minimum.reduceat(ids, first) if first.size else ids
    h = h[first]
    return B.packed_table([(block, p, B.pack(B.delta(h[s]), low[s])) for p, s in B.split_sorted(h, parts)])


def _smallest(p: int, ids: list[int], datas: list[bytes]):
    """To each block, the hashes that start in a smaller id elsewhere, with that id."""
    got = [B.unpack(d, U64, np.int64) for d in datas]
    mine = [B.undelta(d) for d, _ in got]
    every, low = np.concatenate(mine), np.concatenate([x for _, x in got])
    order = np.argsort(every, kind="stable")
    first = B.firsts(every[order])
    values, low = every[order][first], np.minimum.reduceat(low[order], first)
    for b, m, (_, own) in zip(ids, mine, got, strict=True):
        least = low[np.searchsorted(values, m)]
        if (less := least < own).any():
            yield b, B.pack(B.delta(m[less]), least[less])


def _removed(w: _Words, length: int, answers: list[tuple[int, bytes]], at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Mask of the words covered by a window that starts in a smaller id, here or elsewhere."""
    gone = np.zeros(w.hash.size + 1, np.int64)
    if at.size:
        ids = w.id[w.row[at]]
        order = np.argsort(h, kind="stable")
        first = B.firsts(h[order])
        values, low = h[order][first], np.minimum.reduceat(ids[order], first)
        for _, d in answers:
            dh, least = B.unpack(d, U64, np.int64)
            k = np.searchsorted(values, B.undelta(dh))
            low[k] = np.minimum(low[k], least)
        hit = at[low[np.searchsorted(values, h)] < ids]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + length, -1)
    return np.cumsum(gone[:-1]) > 0


def _judge(docs: DataFrame, window: int, shortest: int, finish, schema: str, block_bytes: int) -> DataFrame:
    sealed = B.seal(docs, block_bytes)
    parts = B.partitions(sealed)
    steps = levels(window, shortest)

    def lowest(b, t):
        w = _Words(t)
        return (_owners if len(steps) == 1 else _probe)(w, b, *w.windows(steps[0]), parts).to_batches()

    packed, known = B.map_blocks(sealed, lowest, B.PACKED), None
    for below, length in zip(steps, steps[1:], strict=False):
        known = B.store(B.reduce_parts(packed, _repeated), "uncompressed")
        if known.isEmpty():
            break
        send = _owners if length == window else _probe

        def next_level(b, t, answers, below=below, length=length, send=send):
            w = _Words(t)
            return send(w, b, *_candidates(w, length, below, answers), parts)

        packed = B.meet_blocks(sealed, known, next_level, B.PACKED)
    if known is None or not known.isEmpty():
        answers = B.reduce_parts(packed, _smallest)
    else:
        answers = known  # nothing is repeated

    def last(b, t, got):
        w = _Words(t)
        return finish(t, w, _removed(w, window, got, *w.windows(window)))

    return B.meet_blocks(sealed, answers, last, schema)


def _kept_texts(w: _Words, gone: np.ndarray) -> list[bytes]:
    """Per row, the kept words joined by one space."""
    edges = np.searchsorted(w.row, np.arange(len(w.texts) + 1))
    out = []
    for i, text in enumerate(w.texts):
        words = text.split()
        g = gone[edges[i]:edges[i + 1]]
        out.append(b" ".join(words if not g.any() else [x for x, dead in zip(words, g.tolist(), strict=True) if not dead]))
    return out


def substring_dedup(docs: DataFrame, window: int = 13, shortest: int = 7, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for each row of ``docs``."""

    def finish(t, w, gone):
        n = len(w.texts)
        return pa.table({
            "doc_id": t.column("doc_id").cast(pa.int64()),
            "n_words": np.bincount(w.row, minlength=n).astype(np.int64),
            "n_removed": np.bincount(w.row[gone], minlength=n).astype(np.int64),
            "kept_sha256": [hashlib.sha256(x).hexdigest() for x in _kept_texts(w, gone)],
        })

    return _judge(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), window, shortest, finish,
                  "doc_id long, n_words long, n_removed long, kept_sha256 string", block_bytes)


def remove_repeats(docs: DataFrame, window: int = 13, shortest: int = 7, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """``docs`` with all its columns; ``text`` is the kept words where any word went, else unchanged."""
    schema = B.arrow_schema(docs.schema)

    def finish(t, w, gone):
        hit = set(np.unique(w.row[gone]).tolist())
        kept = _kept_texts(w, gone) if hit else []
        texts = [kept[i].decode() if i in hit else x for i, x in enumerate(t.column("text").to_pylist())]
        return t.set_column(t.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).cast(schema)

    return _judge(docs, window, shortest, finish, docs.schema, block_bytes)
