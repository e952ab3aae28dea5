"""Line dedup by a deletion-neighbourhood join.

Lines are the ``\\n``-split parts of a text, compared as sequences of words ``[^\\x20\\x09-\\x0D]+``.
A line goes if an earlier line (by doc_id, then line number) of the input has the same words, or, for lines of
``min_words`` words or more, lies within one word edit (a word put in, left out or replaced). Shorter lines
match equal lines alone; lines without a word stay.

Each line emits its hash and the hash of every variant with one word left out. Lines whose variants are equal
meet under one key, where the edit distance is verified from the positions: two variants are one
edit apart if the same position was left out (a replaced word) or if one of them is a whole line (a word put in); other
equal variants are a word moved, two edits, and don't count. A key keeps only minima of (doc_id, line), never
pairs. Only lines that share their first or last half with another one emit variants, for one edit leaves
one half intact; so the keys that all lines send are two or four a line.

Defined cases: null text has no lines and stays null, empty text has one line and stays; lines of rows with
the same doc_id and line number (repeated rows) are not earlier than one another, so both stay; rows with a
null id keep all lines and remove none; other columns pass unchanged in ``dedup_lines``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorscan.llm import blocks as B

U64 = np.uint64
LOW = U64(24)
SHORT = U64(0x5851F42D4C957F2D)  # keeps short lines' keys apart from variants


class _Lines:
    """The lines of one block with prefix sums over their word hashes."""

    def __init__(self, t: pa.Table):
        self.texts = B.texts_of(t)
        buf, row_starts = B.join_texts(self.texts)
        newlines = np.flatnonzero(buf == 10)
        self.row = np.searchsorted(row_starts, newlines[:-1] + 1, "right") - 1 if self.texts else np.zeros(0, np.int64)
        self.number = np.arange(self.row.size) - np.searchsorted(self.row, self.row)
        starts, ends = B.word_spans(buf, B.ASCII_SPACE)
        words = B.word_hashes(buf, starts, ends)
        edges = np.searchsorted(starts, newlines)
        self.a, self.b = edges[:-1], edges[1:]
        self.n = self.b - self.a
        self.sums = B.prefix_sums(words)
        self.inv = B.powers(B._INV, words.size + 1)
        ids = t.column("doc_id")
        self.null = np.array(ids.is_null().to_numpy(), bool)
        self.id = ids.fill_null(0).to_numpy().astype(np.int64)
        self.live = (self.n > 0) & ~self.null[self.row]

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._end((self.sums[b] - self.sums[a]) * self.inv[a], b - a)

    @staticmethod
    def _end(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        return B.mix(h ^ (n.astype(U64) * U64(0xA24BAED4963EE407)))

    def halves(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, key): the first and last k words, for the k of this length and of one word less."""
        a, b, n = self.a[lines], self.b[lines], self.n[lines]
        who, keys = [], []
        for k, some in ((n // 2, np.ones(n.size, bool)), ((n - 1) // 2, n % 2 == 0)):
            x, y, z = a[some], b[some], k[some]
            who += [lines[some]] * 2
            keys += [self.span(x, x + z), B.mix(self.span(y - z, y))]
        return np.concatenate(who), np.concatenate(keys)

    def variants(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, tag, key): the whole line (tag 0) and each word left out (its position + 1)."""
        n = self.n[lines]
        who = np.repeat(lines, n)
        gap = np.arange(who.size) - np.repeat(np.cumsum(n) - n, n)
        a, b = self.a[who], self.b[who]
        q = a + gap
        h = (self.sums[q] - self.sums[a]) + (self.sums[b] - self.sums[q + 1]) * self.inv[1:2]
        h = self._end(h * self.inv[a], b - a - 1)
        whole = self.span(self.a[lines], self.b[lines])
        return np.r_[lines, who], np.r_[np.zeros(lines.size, np.int64), gap + 1].astype(np.uint32), np.r_[whole, h]


def _probe(x: _Lines, block: int, min_words: int, parts: int):
    _, keys = x.halves(np.flatnonzero(x.live & (x.n >= min_words)))
    h = np.sort(keys) >> LOW << LOW
    first = B.firsts(h)
    multi = (np.diff(np.r_[first, h.size]) > 1).astype(np.uint8)
    h = h[first]
    yield from B.packed_batches((block, p, B.pack(B.delta(h[s] >> LOW), multi[s])) for p, s in B.split_sorted(h, parts))


def _repeated(p: int, ids: list[int], datas: list[bytes]):
    """To each block, those of its keys that another line has."""
    got = [B.unpack(d, U64, np.uint8) for d in datas]
    mine = [B.undelta(d) for d, _ in got]
    every = np.sort(np.concatenate(mine + [m[f > 0] for m, (_, f) in zip(mine, got, strict=True)]))
    first = B.firsts(every)
    twice = every[first][np.diff(np.r_[first, every.size]) > 1]
    for b, m in zip(ids, mine, strict=True):
        if (hit := m[np.isin(m, twice, assume_unique=True)]).size:
            yield b, B.pack(B.delta(hit))


class _Entries:
    """What a block sends: of each (key, tag) its earliest lines. The later ones go already here."""

    def __init__(self, x: _Lines, known: list[bytes], min_words: int):
        long = np.flatnonzero(x.live & (x.n >= min_words))
        who, keys = x.halves(long)
        repeated = np.concatenate([B.undelta(B.unpack(d, U64)[0]) for d in known]) if known else np.zeros(0, U64)
        near = np.unique(who[np.isin(keys >> LOW, repeated)])
        line, tag, key = x.variants(near)
        short = np.flatnonzero(x.live & (x.n < min_words))
        line, tag = np.r_[line, short], np.r_[tag, np.zeros(short.size, np.uint32)]
        key = np.r_[key, B.mix(x.span(x.a[short], x.b[short]) ^ SHORT)]
        order = np.lexsort((x.number[line], x.id[x.row[line]], tag, key))
        line, tag, key = line[order], tag[order], key[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])] if key.size else np.zeros(0, bool)
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if key.size else np.zeros(0, np.int64)
        ids, number = x.id[x.row[line]], x.number[line]
        least = (ids == ids[head]) & (number == number[head])
        self.gone_here = line[~least]
        self.line, self.tag, self.key = line[least], tag[least], key[least]
        self.id, self.number = ids[least], number[least].astype(np.uint32)

    def send(self, block: int, parts: int) -> pa.Table:
        return B.packed_table([
            (block, p, B.pack(B.delta(self.key[s]), self.tag[s], self.id[s], self.number[s]))
            for p, s in B.split_sorted(self.key, parts)])


def _earlier(p: int, ids: list[int], datas: list[bytes]):
    """To each block, a bit for each of its entries: an earlier line lies within one edit."""
    got = [B.unpack(d, U64, np.uint32, np.int64, np.uint32) for d in datas]
    sizes = np.cumsum([0, *(g[1].size for g in got)])
    key = np.concatenate([B.undelta(g[0]) for g in got])
    tag, doc, number = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
    place = np.empty(key.size, np.int64)  # rank of (doc, line), equal for equal ones
    order = np.lexsort((number, doc))
    step = (doc[order][1:] != doc[order][:-1]) | (number[order][1:] != number[order][:-1])
    place[order] = np.r_[0, np.cumsum(step)] if key.size else place
    order = np.lexsort((place, tag, key))
    k, t, r = key[order], tag[order], place[order]
    by_key = B.firsts(k)
    size = np.diff(np.r_[by_key, k.size])
    any_least = np.repeat(np.minimum.reduceat(r, by_key), size) if k.size else r
    far = np.iinfo(np.int64).max
    whole_least = np.repeat(np.where(t[by_key] == 0, r[by_key], far), size) if k.size else r
    new = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])] if k.size else np.zeros(0, bool)
    same_least = r[np.flatnonzero(new)[np.cumsum(new) - 1]] if k.size else r
    hit = np.empty(k.size, bool)
    hit[order] = np.where(t == 0, any_least, np.minimum(whole_least, same_least)) < r
    for i, b in enumerate(ids):
        if (bits := hit[sizes[i]:sizes[i + 1]]).any():
            yield b, B.pack(np.packbits(bits))


def _judge(docs: DataFrame, min_words: int, finish, schema, block_bytes: int) -> DataFrame:
    sealed = B.seal(docs, block_bytes, bucketed=True)
    parts = B.partitions(sealed)
    halves = B.map_blocks(sealed, lambda b, t: _probe(_Lines(t), b, min_words, parts), B.PACKED)
    known = B.store(B.reduce_parts(halves, _repeated), "uncompressed")

    def variants(b, t, got):
        return _Entries(_Lines(t), [d for _, d in got], min_words).send(b, parts)

    verdicts = B.reduce_parts(B.meet_blocks(sealed, known, variants, B.PACKED), _earlier)

    def last(b, t, got):
        x = _Lines(t)
        e = _Entries(x, [d for p, d in got if p < parts], min_words)
        gone = np.zeros(x.row.size, bool)
        gone[e.gone_here] = True
        bits = {p - parts: d for p, d in got if p >= parts}
        for p, s in B.split_sorted(e.key, parts):
            if p in bits:
                hit = np.unpackbits(B.unpack(bits[p], np.uint8)[0], count=s.stop - s.start).astype(bool)
                gone[e.line[s][hit]] = True
        return finish(t, x, gone)

    return B.meet_blocks(sealed, known.unionByName(verdicts.withColumn("p", F.col("p") + parts)), last, schema)


def _kept(x: _Lines, gone: np.ndarray) -> list[bytes]:
    edges = np.searchsorted(x.row, np.arange(len(x.texts) + 1))
    out = []
    for i, text in enumerate(x.texts):
        g = gone[edges[i]:edges[i + 1]]
        out.append(b"\n".join(y for y, dead in zip(text.split(b"\n"), g.tolist(), strict=True) if not dead) if g.any() else text)
    return out


def line_dedup(docs: DataFrame, min_words: int = 6, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the kept lines joined by ``\\n``) for each row of ``docs``."""

    def finish(t, x, gone):
        n, null = len(x.texts), np.array(t.column("text").is_null().to_numpy(), bool)
        return pa.table({
            "doc_id": t.column("doc_id"),
            "n_lines": np.where(null, 0, np.bincount(x.row, minlength=n)).astype(np.int64),
            "n_removed": np.bincount(x.row[gone], minlength=n).astype(np.int64),
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in _kept(x, gone)],
        })

    return _judge(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), min_words, finish,
                  "doc_id long, n_lines long, n_removed long, kept_sha256 string", block_bytes)


def dedup_lines(docs: DataFrame, min_words: int = 6, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """``docs`` with all its columns, ``text`` without the removed lines."""
    schema = B.arrow_schema(docs.schema)

    def finish(t, x, gone):
        hit = set(np.unique(x.row[gone]).tolist())
        kept = _kept(x, gone)
        texts = [kept[i].decode() if i in hit else v for i, v in enumerate(t.column("text").to_pylist())]
        return t.set_column(t.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).cast(schema)

    return _judge(docs, min_words, finish, docs.schema, block_bytes)
