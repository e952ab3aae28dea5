"""Stupid-backoff language-model scores, counted and joined relationally.

Relations: ``counts(gram, n)`` over all documents, partitioned by the gram's hash, and
``grams(document, position, gram)``, the exploded n-grams. A document's score sums, over its
words, log S(word | words before): the count of the longest n-gram that the rest of the corpus has
(the document's own occurrences are taken off its counts) over the count of its context, times
``alpha`` for each order given up; a word unknown elsewhere counts as alpha^order / N.

Both relations are packed (see ``blocks``): a block sends each distinct gram once
with its count, the hash partition adds the counts up and joins them
back to the grams it got, and the block sums per document. Words and pairs go first; of each longer
order only the grams whose two parts one word shorter both stand in another document follow. No other gram can stand
in another document, and all documents of one that does send it, so its counts are whole. The blocks lie in
hash buckets, so that meeting the answers of each round moves no text.

Defined cases: null or empty text has no words and score 0.0; repeated rows are documents of
their own, so each sees the others; a row with a null id is counted and scored like any other;
an only document scores every word as unknown with N = 1; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from authorscan.llm import blocks as B

U64 = np.uint64


class _Grams:
    """The words of one block; n-grams as hashes and the words they end on."""

    def __init__(self, t: pa.Table):
        self.texts = B.texts_of(t)
        buf, row_starts = B.join_texts(self.texts)
        starts, ends = B.word_spans(buf, B.ASCII_SPACE)
        self.words = B.word_hashes(buf, starts, ends)
        self.n = self.words.size
        self.row = np.searchsorted(row_starts, starts, "right") - 1

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        m = max(0, self.n - k + 1)
        at = np.flatnonzero(self.row[:m] == self.row[k - 1:])
        return at + (k - 1), B.window_hashes(self.words, k)[at]


def _counts(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams with counts."""
    every = np.sort(every)
    first = B.firsts(every)
    return every[first], np.diff(np.r_[first, every.size]).astype(np.int64)


def _add_up(p: int, ids: list[int], datas: list[bytes]):
    got = [B.unpack(d, U64, np.int64) for d in datas]
    mine = [B.undelta(d) for d, _ in got]
    every, n = np.concatenate(mine), np.concatenate([x for _, x in got])
    order = np.argsort(every, kind="stable")
    first = B.firsts(every[order])
    values, total = every[order][first], np.add.reduceat(n[order], first)
    for b, m in zip(ids, mine, strict=True):
        yield b, B.pack(total[np.searchsorted(values, m)])


def _own(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each gram, its count in its own document."""
    key = h ^ B.mix(row.astype(U64) + U64(1))
    order = np.argsort(key)
    first = B.firsts(key[order])
    n = np.diff(np.r_[first, key.size])
    out = np.empty(key.size, np.int64)
    out[order] = np.repeat(n, n)
    return out


class _Asked:
    """What one block asks, round by round, and what the answers of the rounds so far (a list for each) say."""

    def __init__(self, g: _Grams, order: int, rounds: list[list[bytes]]):
        self.g = g
        self.elsewhere: list[np.ndarray] = []  # per order, of the gram that ends on each word: its count in other documents
        self.rest = None  # per word, the words of other documents
        self.grams = [g.of(k) for k in range(1, min(order, 2) + 1)]
        self.keys, self.n = _counts(np.concatenate([h for _, h in self.grams]))
        self.keys, self.n = np.r_[U64(0), self.keys], np.r_[g.n, self.n].astype(np.int64)  # gram 0 has the number of words
        for answers in rounds:
            totals = np.concatenate([np.zeros(0, np.int64), *(B.unpack(d, np.int64)[0] for d in answers)])
            if self.rest is None:
                self.rest = np.maximum(totals[0] - np.bincount(g.row, minlength=len(g.texts)), 1)[g.row].astype(np.float64)
            for at, h in self.grams:
                e = np.zeros(g.n, np.int64)
                e[at] = totals[np.searchsorted(self.keys, h)] - _own(h, g.row[at])
                self.elsewhere.append(e)
            if len(self.elsewhere) < order:
                at, h = g.of(len(self.elsewhere) + 1)
                some = (e[at] > 0) & (e[at - 1] > 0)
                self.grams = [(at[some], h[some])]
                self.keys, self.n = _counts(h[some])

    def send(self, block: int, turn: int, parts: int):
        rows = ((block, turn * parts + p, B.pack(B.delta(self.keys[s]), self.n[s])) for p, s in B.split_sorted(self.keys, parts))
        return B.packed_table(list(rows))


def _scores(x: _Asked, order: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Per word, log S and the order used (0: unknown)."""
    log = np.log(alpha ** order / x.rest)
    used = np.zeros(x.g.n, np.int8)
    for k, e in enumerate(x.elsewhere, 1):
        at = np.flatnonzero(e > 0)
        context = x.rest[at] if k == 1 else x.elsewhere[k - 2][at - 1]  # the gram of the words before
        log[at] = np.log(alpha ** (order - k) * e[at] / context)
        used[at] = k
    return log, used


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_backoff (words scored below the highest order), n_unknown, logscore (sum), mean_logscore."""
    sealed = B.seal(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), block_bytes, bucketed=True)
    parts = B.partitions(sealed)

    def asked(t, answers, turn):
        return _Asked(_Grams(t), order, [[d for p, d in answers if p // parts == i] for i in range(turn)])

    counts = B.reduce_parts(B.map_blocks(sealed, lambda b, t: asked(t, [], 0).send(b, 0, parts).to_batches(), B.PACKED), _add_up)
    turns = max(1, order - 1)
    for i in range(1, turns):
        known = B.store(counts, "uncompressed") if i == 1 else known.unionByName(B.store(counts, "uncompressed"))
        sent = B.meet_blocks(sealed, known, lambda b, t, answers, i=i: asked(t, answers, i).send(b, i, parts), B.PACKED)
        counts = B.reduce_parts(sent, _add_up)

    def score(b, t, answers):
        x = asked(t, answers, turns)
        log, used = _scores(x, order, alpha)
        g, n = x.g, len(x.g.texts)
        words = np.bincount(g.row, minlength=n)
        total = np.bincount(g.row, log, minlength=n).astype(np.float64)
        return pa.table({
            "doc_id": t.column("doc_id"), "n_words": words.astype(np.int64),
            "n_backoff": np.bincount(g.row[used < order], minlength=n).astype(np.int64),
            "n_unknown": np.bincount(g.row[used == 0], minlength=n).astype(np.int64),
            "logscore": total, "mean_logscore": total / np.maximum(words, 1),
        })

    return B.meet_blocks(sealed, known.unionByName(counts) if turns > 1 else counts, score,
                         "doc_id long, n_words long, n_backoff long, n_unknown long, logscore double, mean_logscore double")
