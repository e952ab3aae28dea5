"""Quality rules: counted rules, and a hashed n-gram log-likelihood ratio.

Words are ``[^\\x20\\x09-\\x0D]+``. Words and word pairs are hashed to ``buckets`` buckets. Two multinomials are counted over
whole tables: the trusted target (documents labelled quality 1) and the raw corpus (all documents). A bucket weighs
log((t + smooth) / (e + smooth)), where t is its count in the target and e what the raw shares lead to expect there; so
a bucket that few trusted documents could have shown says little. A document's score is the sum over its
words and pairs divided by their number, and a document is kept if it passes the counted rules and
scores at least ``threshold``. Weights are whole numbers of 2^-20, so sums don't depend on their order.

The target is fitted on the trusted documents if there are at most ``trusted_rows`` of them, else on those with the
least hashed ids; so their ids are a broadcast of bounded size and no text is shuffled. The raw corpus is always counted whole.

Only built-in functions run. The counts pre-aggregate to at most ``buckets`` rows a task; the weights are one row with an
array of that fixed length, read by every task as a scalar subquery; scoring a document needs no shuffle.

Defined cases: null or empty text has no words and fails the base rules; a document without words scores 0; repeated rows are
judged each, and counted each in the raw corpus; labels without a document, null or repeated labels change nothing; with no
trusted document all weights are 0; ``quality_filter`` keeps all columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authorscan.llm import blocks as B
from authorscan.llm.blocks import store

BUCKETS = 1 << 16
SCALE = 1 << 20
SPACES = " \t\n\x0b\x0c\r"
THRESHOLD = -0.12
TRUSTED_ROWS = 200_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def swap(text: Column, chars: str, by: str) -> Column:
    """Each of ``chars`` replaced (a few plain passes; translate looks every character up in a map)."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def words(text: Column) -> Column:
    return F.array_remove(F.split(swap(F.coalesce(text, F.lit("")), SPACES[1:], " "), " "), "")


def runs(items: Column, n: int, make) -> Column:
    """``make(first, ..., nth)`` for every ``n`` consecutive items."""
    spans = F.transform(F.sequence(F.lit(0), F.size(items) - n), lambda i: make(*[F.get(items, i + k) for k in range(n)]))
    return F.when(F.size(items) >= n, spans).otherwise(F.array().cast("array<bigint>"))


def buckets_of(hashes: Column, buckets: int) -> Column:
    """Buckets of all words and word pairs, from the words' hashes."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)))
    return F.concat(one, runs(hashes, 2, lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets))))


def repeated(hashes: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more."""

    def count(h3):
        pairs = F.sort_array(F.transform(h3, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s):
            same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
            where = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(same(j, j - 1) | same(j, j + 1), F.get(s, j)["i"]))
            return F.sort_array(F.array_compact(where))

        def covered(p):
            gaps = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda j: F.least(F.get(p, j) - F.get(p, j - 1), F.lit(3)))
            return F.aggregate(gaps, F.lit(3).cast("long"), lambda a, g: a + g)

        return F.when(F.size(F.array_distinct(h3)) == F.size(h3), F.lit(0).cast("long")).otherwise(
            let(let(pairs, starts), covered))

    return let(runs(hashes, 3, lambda a, b, c: F.xxhash64(a, b, c)), count)


def base_columns(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return {
        "word_chars": F.length(swap(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(swap(t, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def bucket_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all words and word pairs of ``docs``."""
    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    grams = docs.select(F.explode(let(hashes, lambda h: buckets_of(h, buckets))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smooth: float = 5.0, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """One row: the array of all buckets' weights."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows))  # at most trusted_rows longs
    raw = bucket_counts(docs, buckets).select("bucket", F.col("n").alias("raw"), F.lit(0).cast("long").alias("target"))
    target = bucket_counts(docs.join(trusted, "doc_id", "left_semi"), buckets).select(
        "bucket", F.lit(0).cast("long").alias("raw"), F.col("n").alias("target"))
    none = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target"))
    counts = store(raw.unionByName(target).unionByName(none).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    total = counts.agg(F.sum("raw").alias("r"), F.sum("target").alias("t")).first()
    expected = F.col("raw") * ((total["t"] or 0) / max(total["r"] or 0, 1))
    weight = F.round(F.log((F.col("target") + smooth) / (expected + smooth)) * SCALE).cast("long")
    rows = F.sort_array(F.collect_list(F.struct("bucket", weight.alias("w"))))  # as many as there are buckets
    return store(counts.agg(F.transform(rows, lambda x: x["w"]).alias("w")))


def judge(docs: DataFrame, labels: DataFrame, into: str, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept in a struct ``into``."""
    model = weights(docs.select("doc_id", "text"), labels, buckets)
    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))

    def of(pair):
        h, m = pair["h"], pair["m"]
        n = F.size(h)
        total = F.aggregate(buckets_of(h, buckets), F.lit(0).cast("long"), lambda a, b: a + F.get(m, b.cast("int")))
        return F.struct(n.cast("long").alias("n_words"), repeated(h).alias("n_repeat_words"),
                        F.when(n > 0, total / (2 * n - 1) / SCALE).otherwise(F.lit(0.0)).alias("score"))

    m, q, base = (B.free_name(docs, c) for c in ("__model", "__q", "__base"))
    pair = F.struct(hashes.alias("h"), F.col(m).alias("m"))
    out = docs.withColumn(m, model.scalar()).withColumn(q, let(pair, of)).drop(m)
    out = out.withColumn(base, F.struct(*[v.alias(k) for k, v in base_columns(F.col("text")).items()]))
    failed = (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))
    return out.select(*docs.columns, F.struct(
        F.col(f"{q}.n_words"), *[F.col(f"{base}.{c}") for c in ("word_chars", "n_symbols", "n_dup_lines")], F.col(f"{q}.n_repeat_words"),
        F.col(f"{q}.score"), failed.alias("base_failed"), (~failed & (F.col(f"{q}.score") >= threshold)).alias("kept")).alias(into))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id and the judgement's columns for each row of ``docs``."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return judge(docs, labels, "judged", threshold, buckets).select("doc_id", *[F.col(f"judged.{n}").alias(n) for n in names])


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The kept rows of ``docs``. The row number in the condition holds the filter above the judgement: pushed below
    it, the filter would evaluate the score anew for each mention."""
    into, number = B.free_name(docs, "__judged"), B.free_name(docs, "__number")
    judged = judge(docs, labels, into, threshold, buckets).select("*", F.monotonically_increasing_id().alias(number))
    return judged.where(f"{into}.kept AND {number} >= 0").select(*docs.columns)
