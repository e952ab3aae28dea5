"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def substring_dedup(rows, window=13):
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            if i is not None:
                first[x] = min(first.get(x, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def suffix_dedup(rows, length=100):
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        for k in range(len(b) - length + 1):
            if i is not None:
                first[b[k:k + length]] = min(first.get(b[k:k + length], (i, k)), (i, k))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k:k + length]] < (i, k):
                gone[k:k + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _edits(a, b):
    """Word edit distance, as far as one tells 0, 1 and more."""
    if a == b:
        return 0
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True))
    if abs(len(a) - len(b)) > 1:
        return 2
    s, m = sorted((a, b), key=len)
    return 1 if any(m[:k] + m[k + 1:] == s for k in range(len(m))) else 2


def line_dedup(rows, min_words=6):
    lines = []
    for r, (i, text) in enumerate(rows):
        for k, x in enumerate(text.split("\n") if text is not None else []):
            lines.append((i, k, words(x), r))
    out = defaultdict(set)
    for i, k, w, r in lines:
        if w and i is not None and any(
                j is not None and (j, m) < (i, k) and (v == w or min(len(v), len(w)) >= min_words and _edits(v, w) <= 1)
                for j, m, v, _ in lines if v and abs(len(v) - len(w)) < 2):
            out[r].add(k)
    res = []
    for r, (i, text) in enumerate(rows):
        split = text.split("\n") if text is not None else []
        kept = "\n".join(x for k, x in enumerate(split) if k not in out[r])
        res.append((i, len(split), len(out[r]), hashlib.sha256(kept.encode()).hexdigest()))
    return res


def backoff_scores(rows, order=2, alpha=0.4):
    grams = [Counter(tuple(w[k:k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
             for w in (words(t) for _, t in rows)]
    total, n_all = sum(grams, Counter()), sum(len(words(t)) for _, t in rows)
    out = []
    for (i, text), own in zip(rows, grams, strict=True):
        w, log, back, unknown = words(text), 0.0, 0, 0
        rest = max(n_all - len(w), 1)
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1:k + 1])
                c = total[g] - own[g]
                if c:
                    context = rest if n == 1 else total[g[:-1]] - own[g[:-1]]
                    log += math.log(alpha ** (order - n) * c / context)
                    back += n < order
                    break
            else:
                log += math.log(alpha ** order / rest)
                back, unknown = back + 1, unknown + 1
        out.append((i, len(w), back, unknown, round(log, 6)))
    return out


def fingerprint(text, shingle=4):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[k:k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(rows, shingle=4, radius=4):
    fps = [fingerprint(t, shingle) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, f"{fps[k]:016x}", least.get(root(k))) for k, (i, _) in enumerate(rows)]


def contamination(rows, items, window=10, slop=20):
    def toks(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())

    windows = defaultdict(set)
    for i, t in items:
        w = toks(t)
        for k in range(max(0, len(w) - window) + 1 if w else 0):
            windows[tuple(w[k:k + window])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, got = toks(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in windows:
                    hit |= set(range(k, k + n))
                    got |= windows[x]
        got = sorted(str(x) for x in got if x is not None)
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(got).encode()).hexdigest(), bool(hit)))
    return out
