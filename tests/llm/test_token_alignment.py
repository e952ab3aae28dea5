"""Token alignment against a version that compares every pair of byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from authorscan.llm import token_alignment as T
from authorscan.llm import tokens
from authorscan.llm.queries import tokenizer_path

A, P = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
RNG = random.Random(5)
VOCAB = "the of And ünd stone river é | ### x1 日本語 <s> <|endoftext|> don't 👍🏽 \x00 \x1c 　 zz\tq".split(" ")


def _text(n):
    return "".join(RNG.choice(VOCAB) + RNG.choice([" ", "  ", "\n", ""]) for _ in range(n))


ROWS = [(i, _text(RNG.randint(0, 40))) for i in range(40)]
ROWS += [(50, None), (51, ""), (None, ROWS[3][1]), (3, ROWS[3][1]), (52, "a ▁ b"), (53, " "), (54, "far " * 3000), (55, "x" * 5000), (-1, " \n\t ")]


def ranges(ids, size):
    out, at = [], 0
    for i in ids:
        out.append((at, at + size[i], i))
        at += size[i]
    return out


def brute(rows):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=P)
    a_bytes = tokens.byte_tokens(A).bytes
    docs, count = [], Counter()
    for i, x in rows:
        ids = t.encode(" " + x, add_special_tokens=False).ids if x else []
        pieces = s.encode(x) if x else []
        raw = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in s.id_to_piece(pieces)]
        if x and not b"".join(a_bytes[k] for k in ids) == (" " + x).encode() == b"".join(raw):
            ids, pieces, raw = [], [], []
        ra = ranges(ids, [len(b) for b in a_bytes])
        rb, at = [], 0
        for p, r in zip(pieces, raw, strict=True):
            rb.append((at, at + len(r), p))
            at += len(r)
        links = [(p[2], q[2]) for p in ra for q in rb if p[0] < q[1] and q[0] < p[1]] if len(ra) < 2000 else _sweep(ra, rb)
        count.update(links)
        ends = sorted({p[1] for p in ra} & {q[1] for q in rb})
        groups, lo = [], 0
        for e in ends:
            groups.append(([p[2] for p in ra if lo < p[1] <= e], [q[2] for q in rb if lo < q[1] <= e]))
            lo = e
        docs.append((i, ids, pieces, links, groups))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for i, ids, pieces, links, groups in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(ids), len(pieces), len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if ids else "", sum(len(x) * len(y) for x, y in groups)))
    return out


def _sweep(ra, rb):
    out, j = [], 0
    for p in ra:
        while rb[j][1] <= p[0]:
            j += 1
        k = j
        while k < len(rb) and rb[k][0] < p[1]:
            out.append((p[2], rb[k][2]))
            k += 1
    return out


KEY = lambda x: [(v is None, v if v is not None else 0) for v in x]


def _df(spark, rows=ROWS):
    return spark.createDataFrame([(i, x, 7) for i, x in rows], "doc_id long, text string, block int").repartition(3)


def test_alignment(spark, monkeypatch):
    got = T.alignment(_df(spark), A, P, block_bytes=900).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(brute(ROWS), key=KEY)


def test_links_and_groups_as_rows(spark):
    rows = [r for r in ROWS if r[0] is not None and 10 <= r[0] < 20]
    links = Counter((r.doc_id, r.a_id, r.b_id) for r in T.overlap_links(_df(spark, rows), A, P).collect())
    want = {r[0]: r for r in brute(rows)}
    assert Counter(k[0] for k in links.elements()) == Counter({i: w[4] for i, w in want.items() if w[4]})
    by = defaultdict(lambda: defaultdict(lambda: ([], [])))
    for r in sorted(T.token_groups(_df(spark, rows), A, P).collect(), key=lambda r: (r.doc_id, r["index"])):
        by[r.doc_id][r.group][r.side == "b"].append(str(r.id))
    for i, groups in by.items():
        text = ";".join(f"{','.join(groups[g][0])}|{','.join(groups[g][1])}" for g in sorted(groups))
        assert sorted(groups) == list(range(want[i][3])) and hashlib.sha256(text.encode()).hexdigest() == want[i][7]


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.integers(0, 2, (7, 9)), rng.integers(0, 2, (9, 5))
        a, b = (T.Csr(np.r_[0, np.cumsum(m.sum(1))], np.nonzero(m)[1], m.shape[1]) for m in (x, y))
        got = np.zeros((7, 5), int)
        for i, j, v in T.product(a, b, slab=6):
            got[i, j] = v
        assert (got == x @ y).all() and (T.product_sizes(a, b) == (x @ y).sum(1)).all()
        t = b.transposed()
        assert t.rows == 5 and [t.indices[t.indptr[r]:t.indptr[r + 1]].tolist() for r in range(5)] == [np.flatnonzero(y[:, r]).tolist() for r in range(5)]


def test_long_texts_are_encoded_in_parts_with_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 30)
    piece, byte = tokens.PieceTokens(P), tokens.ByteTokens(A)
    assert piece.cut and byte.fast
    for _ in range(300):
        x = _text(RNG.randint(0, 60)) + RNG.choice(["", " ", "   "])
        assert piece.ids(x) == piece.model.encode(x)
        assert byte.ids(x) == byte.whole.encode(x, add_special_tokens=False).ids
    blank = " " * 300_000 + "a" + "\n" * 200_000
    assert byte.ids(blank) == byte.whole.encode(blank, add_special_tokens=False).ids


def test_token_strings_side_by_side_keep_the_merges_order():
    byte = tokens.ByteTokens(A)
    some = [b.decode("utf-8", "ignore") for b in byte.bytes]
    for _ in range(3000):
        x = "".join(RNG.choices(some, k=5))
        assert byte.ids(x) == byte.whole.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")]])
def test_nothing_to_align(spark, rows):
    got = T.alignment(spark.createDataFrame(rows, "doc_id long, text string"), A, P).collect()
    assert [tuple(r) for r in got] == [(i, 0, 0, 0, 0, 0, 0, "", 0) for i, _ in rows]


def test_a_very_long_text_is_aligned_in_slabs(spark):
    rows = [(1, "the river stone " * 70_000), (2, "ünd" * 200_000)]
    got = {r.doc_id: r for r in T.alignment(spark.createDataFrame(rows, "doc_id long, text string"), A, P).collect()}
    assert got[1].n_links == max(got[1].n_a, got[1].n_b) and got[1].n_a >= 210_000 and got[2].n_links >= got[2].n_a > 0
