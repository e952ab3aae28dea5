"""Suffix dedup by a depth-limited radix sort.

Suffixes of the texts' UTF-8 bytes are ordered only through their first ``length`` bytes. The first, most
significant digit deals them out over the cluster, later digits refine it where more than one suffix
is left, and a suffix alone in its group is dropped at once. Suffixes that are still together after the
last digit are exactly the repeated windows; all but the earliest (doc_id, then start) go.

The first digit of a suffix is the least (by hash) ``gram``-byte string in its first ``length`` bytes and
where that lies: equal windows have equal ones, and neighbouring suffixes mostly share one, so the whole corpus
sends one 40-bit hash for about 35 suffixes. Groups with more than one member send the bytes
of their suffixes (about ``length`` + 35 for each such run). The digits after it are ``digit`` bytes wide.
A first digit with more than ``hot`` runs (a frequent line in differing surroundings) would be one task's: its suffixes
are dealt by the hash of all ``length`` bytes instead, the earliest of equal ones for each block.

Defined cases: null text is empty; texts shorter than ``length`` stay whole; equal (doc_id, start) of repeated rows
are not earlier than each other, so both stay; rows with a null id keep all bytes and remove none; other columns are
ignored. Cutting bytes can split a character, so ``keep_bytes`` returns binary.
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
PLACE = U64((1 << 31) - 1)  # a block has fewer bytes
BLOCK_BYTES = 2 << 20
HOT_RUNS = 1 << 14  # of about 135 bytes and 35 suffixes
PART_BYTES = 4 << 20  # a byte can start a window, so a partition has more of them than one of words


class _Runs:
    """Runs of suffix starts of one block that share their first digit: starts [s, e), anchor a, digit key."""

    def __init__(self, t: pa.Table, length: int, gram: int):
        self.texts = B.texts_of(t)
        self.buf, self.row_starts = B.join_texts(self.texts)
        ids = t.column("doc_id")
        null = np.array(ids.is_null().to_numpy(), bool)
        self.id = ids.fill_null(0).to_numpy().astype(np.int64)
        size = self.buf.size
        self.s = self.e = self.a = self.row = self.offset = np.zeros(0, np.int64)
        self.key = np.zeros(0, U64)
        if size < length + 2:
            return
        sums = B.prefix_sums(self.buf.astype(U64) + U64(1))
        h = sums[gram:] - sums[:-gram]
        del sums
        h *= B.powers(B._INV, h.size)
        h = B.mix(h)
        low = (h & ~PLACE) | np.arange(h.size, dtype=U64)
        wide, width = 1, length - gram + 1
        while wide * 2 <= width:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        if width > wide:
            low = np.minimum(low[:low.size - (width - wide)], low[width - wide:])
        low = (low & PLACE).astype(np.int64)  # of every start, where its least gram lies
        change = np.zeros(low.size + 1, bool)
        change[0] = change[-1] = True
        change[1:-1] = low[1:] != low[:-1]
        ends = self.row_starts + np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        valid = np.zeros(low.size + 1, np.int8)
        whole = (ends - self.row_starts >= length) & ~null
        np.add.at(valid, self.row_starts[whole], 1)
        np.add.at(valid, ends[whole] - length + 1, -1)
        valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
        change[1:-1] |= valid[1:] != valid[:-1]
        edges = np.flatnonzero(change)
        s, e = edges[:-1], edges[1:]
        ok = valid[s]
        self.s, self.e = s[ok], e[ok]
        self.a = low[self.s]
        self.key = B.mix(h[self.a])  # the least hashes are small; as keys they spread again
        self.row = np.searchsorted(self.row_starts, self.s, "right") - 1
        self.offset = self.s - self.row_starts[self.row]


def _same(x: _Runs, runs: np.ndarray, length: int) -> np.ndarray:
    """Equal for runs of the same bytes and the same place of the anchor."""
    if not runs.size:
        return np.zeros(0, U64)
    return B.span_hash(x.buf, x.s[runs], x.e[runs] + (length - 1)) ^ B.mix((x.a[runs] - x.s[runs]).astype(U64) + U64(1))


def _probe(x: _Runs, block: int, parts: int, length: int):
    """Every digit once, with how many differing runs it has here (two at least if it has several)."""
    order = np.argsort(x.key)
    h = x.key[order] >> LOW << LOW
    first = B.firsts(h)
    size = np.diff(np.r_[first, h.size])
    digit = np.repeat(np.arange(first.size), size)
    several = np.repeat(size > 1, size)
    digit, same = digit[several], _same(x, order[several], length)
    o = np.lexsort((same, digit))
    new = B.firsts(digit[o]) if not o.size else np.flatnonzero(np.r_[True, (digit[o][1:] != digit[o][:-1]) | (same[o][1:] != same[o][:-1])])
    n = np.maximum(np.bincount(digit[o][new], minlength=first.size), np.minimum(size, 2)).astype(np.uint32)
    h = h[first]
    yield from B.packed_batches((block, p, B.pack(B.delta(h[s] >> LOW), n[s])) for p, s in B.split_sorted(h, parts))


def _repeated(p: int, ids: list[int], datas: list[bytes], hot: int):
    """To each block, its digits that stand more than once, and whether they are hot."""
    got = [B.unpack(d, U64, np.uint32) for d in datas]
    mine = [B.undelta(d) for d, _ in got]
    every, n = np.concatenate(mine), np.concatenate([x for _, x in got]).astype(np.int64)
    order = np.argsort(every)
    first = B.firsts(every[order])
    total = np.add.reduceat(n[order], first)
    values, total = every[order][first][total > 1], total[total > 1]
    for b, m in zip(ids, mine, strict=True):
        if (hit := m[np.isin(m, values, assume_unique=True)]).size:
            yield b, B.pack(B.delta(hit), (total[np.searchsorted(values, hit)] > hot).astype(np.uint8))


class _Hot:
    """The suffixes of hot runs that a block sends: of equal windows the earliest."""

    def __init__(self, x: _Runs, runs: np.ndarray, length: int):
        n = x.e[runs] - x.s[runs]
        start = np.repeat(x.s[runs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row = np.repeat(x.row[runs], n)
        key = B.span_hash(x.buf, start, start + length) if start.size else np.zeros(0, U64)
        ids, offset = x.id[row], start - x.row_starts[row]
        order = np.lexsort((offset, ids, key))
        start, key, ids, offset = start[order], key[order], ids[order], offset[order]
        first = B.firsts(key)
        of = np.repeat(np.arange(first.size), np.diff(np.r_[first, key.size]))
        head = first[of]
        least = (ids == ids[head]) & (offset == offset[head])
        self.gone = start[~least]
        self.start, self.of = start[least], of[least]
        self.key, self.id, self.offset = key[first], ids[first], offset[first]

    def send(self, block: int, parts: int):
        for p, k in B.split_sorted(self.key, parts):
            yield block, p + parts, B.pack(B.delta(self.key[k]), self.id[k], self.offset[k])


def _least(p: int, ids: list[int], datas: list[bytes]):
    """To each block, a bit for each hot suffix it sent: an equal window starts earlier."""
    got = [B.unpack(d, U64, np.int64, np.int64) for d in datas]
    key = np.concatenate([B.undelta(g[0]) for g in got])
    doc, offset = (np.concatenate([g[i] for g in got]) for i in (1, 2))
    order = np.lexsort((offset, doc, key))
    first = B.firsts(key[order])
    head = order[np.repeat(first, np.diff(np.r_[first, key.size]))]
    hit = np.zeros(key.size, bool)
    hit[order] = (doc[order] != doc[head]) | (offset[order] != offset[head])
    at = 0
    for b, g in zip(ids, got, strict=True):
        if (bits := hit[at:at + g[0].size]).any():
            yield b, B.pack(np.packbits(bits))
        at += g[0].size


class _Sent:
    """The runs a block sends, by key: of equal runs (same bytes, same place of the anchor) the earliest."""

    def __init__(self, x: _Runs, known: list[bytes], length: int):
        got = [B.unpack(d, U64, np.uint8) for d in known]
        repeated = np.concatenate([np.zeros(0, U64), *(B.undelta(d) for d, _ in got)])
        is_hot = np.concatenate([np.zeros(0, np.uint8), *(f for _, f in got)]) > 0
        hot = np.isin(x.key >> LOW, repeated[is_hot])
        self.hot = _Hot(x, np.flatnonzero(hot), length)
        some = np.flatnonzero(np.isin(x.key >> LOW, repeated[~is_hot]) & ~hot)
        same = _same(x, some, length)
        ids, offset = (x.id[x.row[some]], x.offset[some]) if some.size else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((offset, ids, same, x.key[some]))
        some, same, ids, offset = some[order], same[order], ids[order], offset[order]
        key = x.key[some]
        new = np.r_[True, (key[1:] != key[:-1]) | (same[1:] != same[:-1])] if key.size else np.zeros(0, bool)
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if key.size else np.zeros(0, np.int64)
        least = (ids == ids[head]) & (offset == offset[head])
        self.gone = some[~least]
        self.run, self.key, self.id, self.offset = some[least], key[least], ids[least], offset[least]

    def send(self, x: _Runs, block: int, parts: int, length: int) -> pa.Table:
        rows = []
        raw = x.buf.tobytes() if self.run.size else b""
        for p, k in B.split_sorted(self.key, parts):
            r = self.run[k]
            s, e = x.s[r], x.e[r]
            heads = B.pack(B.delta(self.key[k]), self.id[k], self.offset[k], (e - s).astype(np.uint32), (x.a[r] - s).astype(np.uint32))
            text = b"".join(raw[i:j + length - 1] for i, j in zip(s.tolist(), e.tolist(), strict=True))
            rows.append((block, p, len(heads).to_bytes(4, "little") + heads + B._codec()[0].compress(text)))
        return B.packed_table([*rows, *self.hot.send(block, parts)])


def _sort(p: int, ids: list[int], datas: list[bytes], length: int, digit: int):
    """To each block, a bit for each suffix it sent: an equal window starts earlier."""
    heads, texts = [], []
    for d in datas:
        n = int.from_bytes(d[:4], "little")
        heads.append(B.unpack(d[4:4 + n], U64, np.int64, np.int64, np.uint32, np.uint32))
        texts.append(B._codec()[1].decompress(d[4 + n:]))
    key = np.concatenate([B.undelta(h[0]) for h in heads])
    doc, offset, count, anchor = (np.concatenate([h[i] for h in heads]).astype(np.int64) for i in (1, 2, 3, 4))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    del texts
    sums, inv = B.prefix_sums(buf.astype(U64) + U64(1)), B.powers(B._INV, buf.size + 1)
    base = np.cumsum(count + length - 1) - (count + length - 1)
    order = np.lexsort((offset, doc))  # runs of a document have no start in common, so runs in order give suffixes in order
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (offset[order][1:] != offset[order][:-1])][:key.size]
    before = np.cumsum(count[order]) - count[order]
    rank = np.empty(key.size, np.int64)
    rank[order] = before[np.flatnonzero(new)[np.cumsum(new) - 1]] if key.size else rank
    run = np.repeat(np.arange(key.size), count)
    step = np.arange(run.size) - np.repeat(np.cumsum(count) - count, count)
    start, place = base[run] + step, rank[run] + step
    # the first digit: the anchor's bytes and its place in the window
    group = key[run] ^ B.mix((anchor[run] - step).astype(U64) + U64(1))
    del run, step
    live = np.arange(group.size)
    hit = np.zeros(group.size, bool)
    for at in range(0, length, digit):
        i = start[live] + at
        group = B.mix(group + (sums[i + min(digit, length - at)] - sums[i]) * inv[i] * U64(0xD6E8FEB86659FD93))
        order = np.argsort(group)
        group, live = group[order], live[order]
        first = B.firsts(group)
        size = np.diff(np.r_[first, group.size])
        several = np.repeat(size > 1, size)  # a suffix alone is sorted already
        group, live = group[several], live[several]
        if not live.size:
            break
    if live.size:
        first = B.firsts(group)
        o = place[live]
        hit[live] = o > np.repeat(np.minimum.reduceat(o, first), np.diff(np.r_[first, group.size]))
    at = 0
    for b, h in zip(ids, heads, strict=True):
        n = int(h[3].sum())
        if (bits := hit[at:at + n]).any():
            yield b, B.pack(np.packbits(bits))
        at += n


def _judge(docs: DataFrame, length: int, gram: int, digit: int, finish, schema, block_bytes: int, hot: int) -> DataFrame:
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    sealed = B.seal(docs, block_bytes)
    parts = B.partitions(sealed, PART_BYTES)
    digits = B.map_blocks(sealed, lambda b, t: _probe(_Runs(t, length, gram), b, parts, length), B.PACKED)
    known = B.store(B.reduce_parts(digits, lambda p, ids, datas: _repeated(p, ids, datas, hot)), "uncompressed")

    def runs(b, t, got):
        x = _Runs(t, length, gram)
        return _Sent(x, [d for _, d in got], length).send(x, b, parts, length)

    sent = B.meet_blocks(sealed, known, runs, B.PACKED)
    verdicts = B.reduce_parts(sent, lambda p, ids, datas: _sort(p, ids, datas, length, digit) if p < parts else _least(p, ids, datas))

    def last(b, t, got):
        x = _Runs(t, length, gram)
        y = _Sent(x, [d for p, d in got if p < parts], length)
        cover = np.zeros(x.buf.size + 1, np.int32)
        np.add.at(cover, x.s[y.gone], 1)  # runs with an equal earlier one in this block
        np.add.at(cover, x.e[y.gone] + (length - 1), -1)
        bits = {p - parts: d for p, d in got if p >= parts}
        for p, k in B.split_sorted(y.key, parts):
            if p in bits:
                r = y.run[k]
                n = x.e[r] - x.s[r]
                hit = np.unpackbits(B.unpack(bits[p], np.uint8)[0], count=int(n.sum())).astype(bool)
                starts = (np.repeat(x.s[r] - (np.cumsum(n) - n), n) + np.arange(hit.size))[hit]
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + length, -1)
        np.add.at(cover, y.hot.gone, 1)
        np.add.at(cover, y.hot.gone + length, -1)
        later = np.zeros(y.hot.key.size, bool)
        for p, k in B.split_sorted(y.hot.key, parts):
            if p + parts in bits:
                later[k] = np.unpackbits(B.unpack(bits[p + parts], np.uint8)[0], count=k.stop - k.start).astype(bool)
        starts = y.hot.start[later[y.hot.of]]
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + length, -1)
        return finish(t, x, np.cumsum(cover[:-1], dtype=np.int32) > 0)

    return B.meet_blocks(sealed, known.unionByName(verdicts.withColumn("p", F.col("p") + parts)), last, schema)


def _per_row(x: _Runs, gone: np.ndarray):
    """(kept bytes, removed, spans) of every row."""
    for s, text in zip(x.row_starts.tolist(), x.texts, strict=True):
        g = gone[s:s + len(text)]
        n = int(np.count_nonzero(g))
        if not n:
            yield text, 0, 0
        else:
            yield x.buf[s:s + len(text)][~g].tobytes(), n, int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1]))


def suffix_dedup(docs: DataFrame, length: int = 100, gram: int = 30, digit: int = 50, block_bytes: int = BLOCK_BYTES,
                 hot: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``."""

    def finish(t, x, gone):
        rows = [(hashlib.sha256(k).hexdigest(), n, m) for k, n, m in _per_row(x, gone)]
        sha, n, m = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({
            "doc_id": t.column("doc_id"), "n_bytes": pa.array(map(len, x.texts), pa.int64()),
            "n_removed": pa.array(n, pa.int64()), "n_spans": pa.array(m, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return _judge(docs, length, gram, digit, finish,
                  "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", block_bytes, hot)


def keep_bytes(docs: DataFrame, length: int = 100, gram: int = 30, digit: int = 50, block_bytes: int = BLOCK_BYTES,
               hot: int = HOT_RUNS) -> DataFrame:
    """doc_id and the bytes kept (binary)."""

    def finish(t, x, gone):
        return pa.table({"doc_id": t.column("doc_id"), "kept": pa.array([k for k, _, _ in _per_row(x, gone)], pa.binary())})

    return _judge(docs, length, gram, digit, finish, "doc_id long, kept binary", block_bytes, hot)
