"""Each operator against its brute-force version, on small awkward inputs."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from authorscan.llm import blocks as B
from authorscan.llm import (decontamination, line_dedup, lm_scoring, packing, quality_rules, queries, sharding, simhash, substring_dedup,
                            suffix_dedup, url_filters)
from authorscan.llm.queries import URL_RULES, tokenizer_path
from authorscan.session import recorded_stages
from tests.llm import brute

RNG = random.Random(11)
VOCAB = "the of And ünd stone river é | ### x1 y2 zz run far".split()


def _text(n):
    return "".join(RNG.choice(VOCAB) + RNG.choice([" ", "  ", "\n", "\t"]) for _ in range(n))


def _rows():
    base = [_text(RNG.randint(0, 60)) for _ in range(20)]
    rows = [(i, RNG.choice(base) + " " + _text(RNG.randint(0, 12))) for i in range(60)]
    rows += [(100, base[3]), (100, base[3]), (101, base[3]), (102, None), (103, ""), (None, base[3]), (None, None),
             (104, " \n\t\n"), (105, "far " * 300), (106, "far " * 290), (107, "x" * 400), (-5, _text(3000))]
    RNG.shuffle(rows)
    return rows


ROWS = _rows()
KEY = lambda x: [(v is None, v if v is not None else 0) for v in x]


def _df(spark, rows=ROWS, n=4):
    out = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, sequence_id string")
    return out.repartition(n) if rows else out


def _same(got, want):
    assert sorted(map(tuple, got), key=KEY) == sorted(want, key=KEY)


def test_substring_dedup(spark):
    _same(substring_dedup.substring_dedup(_df(spark), 5, 2, block_bytes=700).collect(), brute.substring_dedup(ROWS, 5))


def test_suffix_dedup(spark):
    _same(suffix_dedup.suffix_dedup(_df(spark), 40, 12, 15, block_bytes=900).collect(), brute.suffix_dedup(ROWS, 40))


@pytest.mark.parametrize("hot", [1, 5])
def test_suffix_dedup_deals_out_hot_digits(spark, hot):
    phrase = "one frequent line of a licence"
    rows = ROWS + [(1000 + k, f"{k * 7919:09d} {phrase} {k % 40 * 104729:09d} {'tail' * (k % 3)}") for k in range(120)]
    _same(suffix_dedup.suffix_dedup(_df(spark, rows), 40, 12, 15, block_bytes=900, hot=hot).collect(), brute.suffix_dedup(rows, 40))


def test_suffix_dedup_sends_a_hot_digit_to_many_partitions():
    texts = pa.table({"doc_id": pa.array(range(200), pa.int64()),
                      "text": [f"{k * 7919:060d} one frequent line of words, fifty bytes of it here {k * 104729:060d}" for k in range(200)]})
    x = suffix_dedup._Runs(texts, 100, 30)
    probe = [(rb.column("p").to_pylist(), rb.column("data").to_pylist()) for rb in suffix_dedup._probe(x, 0, 64, 100)]
    known = [d for ps, ds in probe for p, data in zip(ps, ds, strict=True) for _, d in suffix_dedup._repeated(p, [0], [data], 50)]
    sent = suffix_dedup._Sent(x, known, 100).send(x, 0, 64, 100)
    assert max(suffix_dedup._Sent(x, known, 100).hot.key.size, 0) > 1000 and sum(p >= 64 for p in sent.column("p").to_pylist()) == 64
    runs = np.unique(suffix_dedup._Sent(x, known, 100).key >> suffix_dedup.LOW, return_counts=True)[1]
    assert not runs.size or runs.max() <= 50


def test_line_dedup(spark):
    _same(line_dedup.line_dedup(_df(spark), 4, block_bytes=700).collect(), brute.line_dedup(ROWS, 4))


def test_line_dedup_keeps_other_columns(spark):
    out = line_dedup.dedup_lines(_df(spark), 4)
    assert out.columns == ["doc_id", "text", "sequence_id"] and out.count() == len(ROWS)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(spark, order):
    got = lm_scoring.backoff_scores(_df(spark), order, block_bytes=700).collect()
    _same([(*tuple(r)[:4], round(r.logscore, 6)) for r in got], brute.backoff_scores(ROWS, order))


def test_backoff_query_counts_trigrams(spark, tmp_path):
    _df(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_lm_scoring(spark, str(tmp_path)).collect()
    _same([(*tuple(r)[:4], round(r.logscore, 6)) for r in got], brute.backoff_scores(ROWS, 3))


def test_backoff_rounds_of_longer_orders(spark):
    got = lm_scoring.backoff_scores(_df(spark), 5, block_bytes=700).collect()
    _same([(*tuple(r)[:4], round(r.logscore, 6)) for r in got], brute.backoff_scores(ROWS, 5))


def test_meeting_blocks_moves_no_text(spark):
    sealed = B.seal(_df(spark).select("doc_id", "text"), 700, bucketed=True)
    met = B.meet_blocks(sealed, spark.createDataFrame([], B.PACKED), lambda b, t, got: t.select(["doc_id"]), "doc_id long")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and met.count() == len(ROWS)


def test_exchanged_entries_grow_in_proportion_to_the_table(spark, monkeypatch):
    monkeypatch.setattr(B, "MIN_PARTS", 1)
    monkeypatch.setattr(B, "GROWS_FROM", 1 << 14)

    def entries(n):
        rng = random.Random(n)
        rows = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(20))) for i in range(n)]
        sealed = B.seal(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 1 << 11)
        parts = B.partitions(sealed, 1 << 11)
        sent = B.map_blocks(sealed, lambda b, t: substring_dedup._probe(w := substring_dedup._Words(t), b, *w.windows(7), parts).to_batches(), B.PACKED)
        return sent.count()

    few, many = entries(200), entries(1600)
    assert 4 <= many / few <= 16  # eight times the rows; powers of two round the partitions


def test_simhash_groups(spark):
    _same(simhash.simhash_groups(_df(spark), 4, 4).collect(), brute.simhash_groups(ROWS))


def test_simhash_cells_are_split_without_losing_links(spark):
    fps = [RNG.getrandbits(64)]
    for _ in range(60):
        fps.append(RNG.choice(fps) ^ (1 << RNG.randrange(64)) ^ (1 << RNG.randrange(64)))
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    got = simhash.groups(spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long"), 4).collect()
    small = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, cell=8)).collect()
    assert {r.component_id for r in got} == {0} and len(small) == len(fps) and len({r.root for r in small}) == 1


def test_near_dedup_keeps_one_row_of_each_group(spark):
    want = {c for _, _, c in brute.simhash_groups(ROWS)}
    out = simhash.near_dedup(_df(spark)).collect()
    assert sorted(r.doc_id for r in out) == sorted(want)


def test_bit_sliced_distances():
    v = np.array([RNG.getrandbits(64) for _ in range(70)] + [7, 7 ^ 31, 7 ^ 15], np.uint64)
    for radius in (0, 1, 3, 4, 7, 20):
        got = simhash.within(v, simhash.planes(v), radius)[:, :v.size]
        want = [[(int(a) ^ int(b)).bit_count() <= radius for b in v] for a in v]
        assert (got == np.array(want)).all()


def test_contamination(spark):
    items = [(1, ROWS[0][1]), (1, ROWS[0][1]), (2, "river far"), (3, ""), (4, None), (None, "zz run far"), (5, ROWS[5][1]), (6, "| ###")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(_df(spark), bench, 4, block_bytes=700, query_bytes=200).collect()
    _same([tuple(r)[:6] for r in got], brute.contamination(ROWS, items, 4))
    assert all(r.n_near_items >= r.n_items for r in got)
    clean = decontamination.decontaminate(_df(spark), bench, 4)
    assert clean.count() == sum(not r.contaminated for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 40 + "beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "gamma beta alpha")], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontamination.contamination(docs, bench, 10, slop=8).collect()}
    assert got == {1: (0, 1), 2: (0, 0)}


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    rows = ROWS + [(200, "<|endoftext|> a\x1cb\x85c\xa0d​e ½² ٣٤ don't ᠎ 👍🏽")]
    want, cover, seqs = defaultdict(list), Counter(), defaultdict(list)
    for i, x in rows:
        want[i].append(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4"))
    for r in packing.pack_documents(_df(spark, rows), tokenizer_path(), tokens=64, segments=5).collect():
        assert any(r.doc_tokens == w.size and r.ids_crc32 == zlib.crc32(w[r.start:r.start + r.length].tobytes()) for w in want[r.doc_id])
        cover[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    assert cover == {i: sum(w.size for w in ws) for i, ws in want.items()}
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        assert sum(n for _, n in s) <= 64 and len(s) <= 5


def test_vector_limits():
    demand = np.array([[5, 1, 0], [5, 1, 9], [5, 1, 9], [11, 1, 0], [1, 1, 1]])
    seq, _ = packing.fill(demand, np.array([10, 2, 10]))
    assert len({*seq.tolist()}) >= 3 and (seq == seq[3]).sum() == 1
    for k in set(seq.tolist()) - {seq[3]}:
        assert (demand[seq == k].sum(0) <= [10, 2, 10]).all()


def test_sharding(spark):
    rows = [(i, t, RNG.choice(["a", "a", "a", "b", None])) for i, t in ROWS]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    mix, of = Counter(s for _, _, s in rows), Counter((r.shard, r.source) for r in out)
    assert all(abs(of[k, s] - mix[s] / 8) <= 2 for k in range(8) for s in mix)


def test_sharding_equals_brute_force(spark):
    rows = [(i, t, RNG.choice(["a", "a", "a", "b", None])) for i, t in ROWS]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    null_first = lambda v: (v is not None, v if v is not None else 0)
    made = []
    for i, t, s in rows:
        raw = (t or "").encode()
        h = signed(xxhash.xxh64_intdigest(("7" if i is None else f"7:{i}").encode(), 42))
        made.append((s, (h, null_first(i), zlib.crc32(raw), len(raw) + 1), i, len(raw) + 1, zlib.crc32(raw)))
    want, ranked = [], []
    for s in {m[0] for m in made}:
        mine = sorted((m for m in made if m[0] == s), key=lambda m: m[1])
        ranked += [((2 * r + 1) / (2 * len(mine)), null_first(s) if s is None else (True, s), m[1], m) for r, m in enumerate(mine)]
    n = len(rows)
    for at, (f, _, _, (s, _, i, size, crc)) in enumerate(sorted(ranked, key=lambda r: r[:3])):
        shard = at * 8 // n
        want.append((i, size, crc, "rows", shard, at - (shard * n + 7) // 8, None, s, round(f, 12)))
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), 8).collect()
    key = lambda x: [(v is None, str(v)) for v in x]
    assert sorted([(*tuple(r)[:8], round(r.fractional_rank, 12)) for r in got], key=key) == sorted(want, key=key)
    assert [tuple(r)[:6] for r in sharding.shard_documents(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, source string"), 8).collect()] == [
        (1, 2, zlib.crc32(b"x"), "rows", 0, 0)]


def test_quality_rules(spark):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)] + [(0, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = quality_rules.quality_rules(_df(spark), labels, buckets=64).collect()
    _check_quality(got, labels.collect(), 64)


def _check_quality(got, labels, m):
    import math

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def chain(hashes):  # each hash seeds the next, over the eight bytes of a long
        seed = 42
        for h in hashes:
            seed = xxhash.xxh64_intdigest((h % (1 << 64)).to_bytes(8, "little"), seed)
        return signed(seed)

    trusted = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    grams = []
    for i, t in ROWS:
        h = [signed(xxhash.xxh64_intdigest(w, 42)) for w in brute.words(t)]
        grams.append([x % m for x in h] + [chain(p) % m for p in zip(h, h[1:])])  # noqa: B905
    raw = Counter(b for g in grams for b in g)
    target = Counter(b for g, (i, _) in zip(grams, ROWS, strict=True) if i in trusted for b in g)
    r, t = sum(raw.values()), sum(target.values())
    weight = {b: round(math.log((target[b] + 5) / (raw[b] * (t / r) + 5)) * (1 << 20)) for b in range(m)}
    want = []
    for g, (i, text) in zip(grams, ROWS, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        c, cov = Counter(zip(w, w[1:], w[2:])), set()  # noqa: B905
        for k in range(len(w) - 2):
            if c[tuple(w[k:k + 3])] > 1:
                cov |= {k, k + 1, k + 2}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(cov) > 50 * len(w)
        score = round(sum(weight[b] for b in g) / max(len(g), 1) / (1 << 20), 5)
        want.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(cov), failed,
                     not failed and score >= quality_rules.THRESHOLD, score))
    _same([(*tuple(x)[:8], round(x.score, 5)) for x in got], want)


def test_url_filters(spark):
    pages = [(1, "http://a.net/x", '<a href="http://B.org/q">'), (2, "http://b.org/de/", '<a href="https://c.org/?">..<a href=//d.org/>'),
             (3, "HTTP://C.org/z?a", "x"), (4, "http://e.org/z", '<a href="http://a.net/">'), (5, "http://t.org/fr/1", "<a href='http://c.org/'>"),
             (6, None, None), (7, "nope", ""), (7, "nope", ""), (8, "http://x.example.com/de/y#z", None), (9, "http://y.net", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_pages(
        spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == {1: ("a.net", "/x", "net/", "block"), 2: ("b.org", "/de/", None, "allow"), 3: ("c.org", "/z", None, "allow"),
                   4: ("e.org", "/z", None, "block"), 5: ("t.org", "/fr/1", "org/fr/", "allow"), 6: ("", "", None, "allow"),
                   7: ("", "", None, "allow"), 8: ("x.example.com", "/de/y", "example.com/de/", "block"), 9: ("y.net", "", None, "allow")}


def test_url_verdicts_do_not_depend_on_unrelated_seeds(spark):
    pages = [(1, "http://a.net/", ""), (2, "http://e.org/z", '<a href="http://a.net/">'), (3, "http://t.org/fr/1", '<a href="http://u.org/">'),
             (4, "http://u.org/z", '<a href="http://a.net/">')]
    pad = [(k, f"http://p{k}.net/", "") for k in range(10, 3010)] + [(k, f"http://q{k}.org/fr/", "") for k in range(3010, 6010)]

    def verdicts(rows):
        out = url_filters.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES)
        return {r.page_id: (r.verdict, r.trust, r.distrust) for r in out.where("page_id < 10").collect()}

    few = verdicts(pages)
    assert few == verdicts(pages + pad) and {k: v[0] for k, v in few.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_distrust_reaches_the_end_of_a_chain(spark):
    pages = [(0, "http://h0.net/", "")] + [(k, f"http://h{k}.org/", f'<a href="http://h{k - 1}.{"net" if k == 1 else "org"}/">') for k in range(1, 23)]
    out = url_filters.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()
    assert {r.verdict for r in out} == {"block"}
    assert all(abs(r.distrust / url_filters.UNIT - 0.15 * 0.85 ** r.page_id) < 1e-8 for r in out)


def _page_rank(edges, seeds, damping=0.85):
    """Personalised PageRank with mass one a seed, by plain iteration in doubles; a host without links passes nothing on."""
    out = defaultdict(Counter)
    for a, b in edges:
        out[a][b] += 1
    rank = {}
    for _ in range(400):
        after = Counter({s: 1 - damping for s in seeds})
        for a, r in rank.items():
            total = sum(out[a].values())
            for b, n in out[a].items():
                after[b] += damping * r * n / total
        rank = dict(after)
    return rank


def test_ranks_on_a_random_graph_with_hubs_and_cycles(spark):
    rng = random.Random(8)
    hosts = [f"h{k}.{rng.choice(['net', 'org', 'com', 'com', 'com'])}" for k in range(30)]
    hub, links = hosts[0], []
    for h in hosts:
        for _ in range(rng.randint(0, 4)):
            links.append((h, rng.choice(hosts)))
        links += [(h, hub)] * rng.randint(0, 2) + ([(hub, h)] if rng.random() < 0.7 else [])
    links += list(zip(hosts[5:12], [*hosts[6:12], hosts[5]], strict=True))  # a cycle of seven
    pages = [(k, f"http://{h}/{'fr/' if h.endswith('org') else ''}p", " ".join(f'<a href="http://{b}/">' for a, b in links if a == h)) for k, h in enumerate(hosts)]
    got = {r.host: r for r in url_filters.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    edges = [(a, b) for a, b in links if a != b]
    trust = _page_rank(edges, [h for h in hosts if h.endswith("org")])
    distrust = _page_rank([(b, a) for a, b in edges], [h for h in hosts if h.endswith("net")])
    for h in hosts:
        r, t, d = got[h], trust.get(h, 0), distrust.get(h, 0)
        assert abs(r.trust / url_filters.UNIT - t) < 1e-7 and abs(r.distrust / url_filters.UNIT - d) < 1e-7
        want = "block" if h.endswith("net") else "allow" if h.endswith("org") else "block" if d >= 1e-4 and d > t else "allow"
        assert r.verdict == want
    assert {got[h].verdict for h in hosts if h.endswith("com")} == {"allow", "block"}


def test_ranks_leave_one_stored_table(spark):
    pairs = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "a")], "kind string, host string")
    with recorded_stages() as written:
        assert url_filters.propagate(pairs, seeds).count() == 3
    assert len(written) <= 6 and all(os.path.isdir(p.removeprefix("file:")) for p, _ in written)  # shares, edges, seeds, the last ranks


def test_repeated_words_need_no_more_memory(spark):
    """A text of 200,000 equal words and an item of 1,000 of them: one distinct window, candidates in batches."""
    import resource

    texts = pa.table({"doc_id": pa.array([1], pa.int64()), "text": ["far " * 200_000]})
    item = type("R", (), {"__getitem__": lambda self, k: {"text": "far " * 1000, "t": 7}[k]})()
    q = decontamination._Queries([item], 10)
    assert q.number.size == 1
    seg = decontamination._segment(0, texts, 50)
    terms, n = decontamination._open_terms(seg["terms"])
    q.plan(np.array([200_000]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    hits = [h for h, _ in decontamination._matches(q, terms, n, decontamination._open_postings(seg["postings"], n), 20)]
    assert sum(p.size for _, p in hits) == 200_000 - 9
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # KB


def test_a_benchmark_of_copies(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "one two three four") for i in range(1000)] + [(i, "five of them") for i in range(1000, 1010)], "item_id long, text string")
    with recorded_stages() as written:
        got = {r.doc_id: r for r in decontamination.contamination(docs, bench, 4).collect()}
    ids = ",".join(sorted(str(i) for i in range(1000)))
    import hashlib
    assert got[1].n_items == 1000 and got[1].n_hit == 4 and got[1].items_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    assert got[2].n_items == 0 and not got[2].contaminated and written


CLASH = ["__row", "__q", "__model", "__judged", "__number", "block", "nth", "fp", "sequence_id"]


def _clashing(spark, rows=ROWS):
    values = [(i, t, *[f"{c}!" for c in CLASH], len(t or "")) for i, t in rows]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH) + ", n_chars long"
    return spark.createDataFrame(values, schema).repartition(3) if rows else spark.createDataFrame([], schema)


@pytest.mark.parametrize("rows", [ROWS, [], [(None, None)], [(1, "long words here and there " * 60_000), (2, None), (3, "")]], ids=["many", "none", "null", "long"])
def test_filters_keep_every_column_as_it_is(spark, rows):
    docs = _clashing(spark, rows)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "river far river"), (2, None)], "item_id long, text string")
    for out in (quality_rules.quality_filter(docs, labels), line_dedup.dedup_lines(docs), simhash.near_dedup(docs), decontamination.decontaminate(docs, bench, 3)):
        assert out.schema.simpleString() == docs.schema.simpleString()
        got = out.collect()
        assert len(got) <= len(rows) and all(r[c] == f"{c}!" for r in got for c in CLASH)


def test_the_quality_score_is_evaluated_once(spark):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    a, b = plan(quality_rules.quality_filter(_df(spark), labels)), plan(quality_rules.quality_rules(_df(spark), labels))
    assert a.count("xxhash64") == b.count("xxhash64") and a.count("scalar-subquery") == b.count("scalar-subquery") == 1


def test_picking_rows_moves_no_text(spark):
    sealed = B.seal(_df(spark).select("doc_id", "text"), 700, bucketed=True)
    rows = spark.createDataFrame([(0, 0)], "block long, nth int")
    plan = B.pick_rows(sealed, rows, _df(spark).select("doc_id", "text").schema)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (substring_dedup.substring_dedup(none), suffix_dedup.suffix_dedup(none), line_dedup.line_dedup(none), lm_scoring.backoff_scores(none),
                simhash.simhash_groups(none), simhash.near_dedup(none), decontamination.contamination(none, bench), sharding.shard_documents(none),
                packing.pack_documents(none, tokenizer_path()), quality_rules.quality_rules(none, labels), url_filters.judge_pages(pages, URL_RULES)):
        assert out.count() == 0
