"""Sentence responses: n-gram language model trained and applied with Spark joins,
the score cache (J1), and a batch hook for the user's own model (M2).

Bigram model (fixed formula, FIXTURES/SURVEY §7.2):
    P1(w)   = (c(w) + 1) / (N + V + 1)
    P(w|u)  = (c(u, w) + beta * P1(w)) / (c(u) + beta),  beta = 5
    response = mean over t >= 2 of -ln P(w_t | w_{t-1})
with c(u) the number of bigrams starting with u, N the token count and V the
vocabulary size of the training side. Texts with fewer than two tokens (and no
context) have no response.
"""

from __future__ import annotations

import math
import sys
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authorscan.operators.scan import MAX_BUCKETS, null_safe_join
from authorscan.functions.text import cache_key, lm_text, lm_tokens
from authorscan.session import cut_lineage, recorded_stages, remove_stages, shuffle_partitions

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions below travel with their tasks

BETA = 5.0  # fixed value of the back-off weight
# Sizes of the packed model and of blocks of texts, in characters; results don't depend on them. Blocks times parts are the
# packed lists that travel: both are as large as a task's memory easily holds, so that a list is worth what a row costs.
# From GROWS_FROM characters on both grow with the square root of the texts, so that packed rows stay in proportion to them.
PART_CHARS, BLOCK_CHARS, PACK_ROWS, GROWS_FROM = 16 << 20, 8 << 20, 1 << 16, 64 << 30
ROUNDS = 4  # blocks ask and are answered in so many rounds at most, each of two blocks a core at least

PACKED = "_part int, _model string, k binary, c binary"


@dataclass
class BigramLM:
    """The model as packed rows (``_part, _model, k, c``): lists of keys with their counts, dealt by the keys' hash.

    ``k``: words (c(w), c(u)) and pairs "u w" (c(u, w), 0) in lists of lines; tokens hold no whitespace.
    The tables of words and pairs are read from it.
    """

    packed: DataFrame
    denominators: DataFrame  # keys, _model, denom = N + V + 1, one row a model
    parts: int
    block_chars: int
    keys: tuple = ()      # columns that tell models apart; they lead every table

    def _counts(self, of, *columns) -> DataFrame:
        rows = self.packed.mapInArrow(_unpack, "_model string, k string, c1 long, c2 long").filter(of)
        if not self.keys:
            return rows.select(*columns)
        return rows.join(self.denominators.drop("denom"), "_model").select(*self.keys, *columns)

    @property
    def unigrams(self) -> DataFrame:  # w, c_w
        return self._counts(~_is_pair(), F.col("k").alias("w"), F.col("c1").alias("c_w"))

    @property
    def prefixes(self) -> DataFrame:  # u, c_u
        return self._counts(~_is_pair() & (F.col("c2") > 0), F.col("k").alias("u"), F.col("c2").alias("c_u"))

    @property
    def bigrams(self) -> DataFrame:  # u, w, c_uw
        at = F.split("k", " ")
        return self._counts(_is_pair(), at[0].alias("u"), at[1].alias("w"), F.col("c1").alias("c_uw"))


def _is_pair():
    return F.col("k").contains(" ")


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _zip_counts(c1: np.ndarray, c2: np.ndarray) -> bytes:
    """Both counts, in as few bytes each (the first byte tells) as the largest needs."""
    c = np.concatenate([c1, c2]).astype(np.int64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or c.max(initial=0) < 1 << 8 * w - 1)
    return bytes([width]) + _zip(c.astype(f"i{width}").tobytes())


def _unzip_counts(data: bytes) -> np.ndarray:
    """Both counts, one row each."""
    return np.frombuffer(_unzip(data[1:]), f"i{data[0]}").reshape(2, -1).astype(np.int64)


def _rows(rows: list[tuple], *fields) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _packed_rows(rows: list[tuple]) -> pa.Table:
    return _rows(rows, ("_part", pa.int32()), ("_model", pa.string()), ("k", pa.binary()), ("c", pa.binary()))


def _split(packed: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The strings of packed lists, one behind the other, and where each list ends."""
    lists = pc.split_pattern(pa.array([_unzip(ks) for ks in packed], pa.large_binary()).cast(pa.large_string()), "\n")
    return lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))


def _keys(packed: list[bytes]) -> pa.Array:
    """The keys of packed lists, one behind the other."""
    return _split(packed)[0]


def _joined(strings: pa.Array, ends) -> list[bytes]:
    """The strings in packed lists that end before ``ends``."""
    lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, ends], pa.int64()), strings.cast(pa.large_string()))
    return [_zip(b) for b in pc.binary_join(lists, pa.scalar("\n", pa.large_string())).cast(pa.large_binary()).to_pylist()]


def _unpack(batches):
    for batch in batches:
        for r in batch.to_pylist():
            c = _unzip_counts(r["c"])
            k = _keys([r["k"]]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r["_model"]] * len(k), pa.string()), k, pa.array(c[0]), pa.array(c[1])], ["_model", "k", "c1", "c2"])


MIX, POWER = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x100000001B3)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of every string: a polynomial of its bytes, summed for all strings at once (modulo 2^64)."""
    words = words.cast(pa.large_string())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    sizes = np.diff(at)
    powers = np.cumprod(np.full(sizes.max(initial=0) + 1, POWER))
    terms = (data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(at[:-1], sizes)]
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]
    return _mixed(sums[at[1:]] - sums[at[:-1]])


def _parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)  # 16 bits are sorted by radix


def _distinct(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``values`` (0 to ``below``), rising, and the place of each value among them.

    A value and its place make one number, where 63 bits hold both: numbers are sorted several times as fast as places by values."""
    bits = len(values).bit_length()
    if below << bits >= 1 << 63:
        return np.unique(values, return_inverse=True)
    both = np.sort(values << bits | np.arange(len(values)))
    values, at = both >> bits, both & ((1 << bits) - 1)
    new = np.r_[True, values[1:] != values[:-1]][:len(values)]
    place = np.empty(len(values), np.int64)
    place[at] = np.cumsum(new) - 1
    return values[new], place


TOTAL = ""  # the key that asks for N + V + 1


def _total_part(parts: int) -> int:
    return int(_parts_of(_hashes(pa.array([TOTAL])), parts)[0])


class _Block:
    """A block's distinct words and pairs (and ``more`` keys), dealt to the parts, and where its pairs stand.

    Words are numbers in the block and pairs numbers of two words: strings are touched once for each distinct word, and for
    each distinct pair where it is sent.
    """

    def __init__(self, texts: pa.Array, parts: int, more: tuple = ()):
        lists = pc.split_pattern(texts, " ")
        words, offsets = lists.flatten(), lists.offsets.to_numpy()
        left = np.delete(np.arange(len(words)), offsets[1:] - 1)
        self.row, self.more = np.repeat(np.arange(len(lists)), np.diff(offsets) - 1), pa.array(more, pa.string())
        of = words.dictionary_encode()
        order = pc.array_sort_indices(of.dictionary).to_numpy()
        self.words, rank = of.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        n = self.n_words = len(order)
        self.word = rank[of.indices.to_numpy()]
        self.first = self.word[left]
        pairs, self.pair = _distinct(self.first * n + self.word[left + 1], n * n)
        self.u, self.w = pairs // max(n, 1), pairs % max(n, 1)
        of_word = _hashes(self.words)
        hashes = np.concatenate([of_word, _mixed(of_word[self.u] * POWER + of_word[self.w]), _hashes(self.more)])
        part = _parts_of(hashes, parts)
        self.order = np.argsort(part, kind="stable")
        self.part = part[self.order]

    def lists(self):
        """Part, first and last place of each part's keys, and the keys, packed."""
        pairs = pc.binary_join_element_wise(self.words.take(pa.array(self.u)), self.words.take(pa.array(self.w)), " ")
        keys = pa.concat_arrays([x.cast(pa.large_string()) for x in (self.words, pairs, self.more)]).take(pa.array(self.order))
        at = np.flatnonzero(np.r_[True, self.part[1:] != self.part[:-1], True]) if len(self.part) else np.zeros(1, np.int64)
        for i, j, packed in zip(at[:-1].tolist(), at[1:].tolist(), _joined(keys, at[1:]), strict=True):
            yield int(self.part[i]), i, j, packed

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """c(w) or c(u, w), and c(u), of every key."""
        n_pairs = len(self.order) - self.n_words
        c1 = np.r_[np.bincount(self.word, minlength=self.n_words), np.bincount(self.pair, minlength=n_pairs)]
        c2 = np.r_[np.bincount(self.first, minlength=self.n_words), np.zeros(n_pairs, np.int64)]
        return c1[self.order], c2[self.order]

    def responses(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """Response of every text; the last key is TOTAL."""
        of1, of2 = np.empty_like(c1), np.empty_like(c2)
        of1[self.order], of2[self.order] = c1, c2
        p1 = (of1[self.w] + 1.0) / max(of1[-1], 1)  # a model without training text has N = V = 0
        nll = -np.log((of1[self.n_words:-1] + BETA * p1) / (of2[self.u] + BETA))
        return np.bincount(self.row, nll[self.pair]) / np.bincount(self.row)


def _merge(lists: pa.Table) -> pa.Table:
    """The lists of one part, one for each model, in rows of up to PACK_ROWS keys."""
    out, part = [], lists["_part"][0].as_py()
    for model in pc.unique(lists["_model"]):
        own = lists.filter(pc.equal(lists["_model"], model))
        of = _keys(own["k"].to_pylist()).dictionary_encode()
        at, order = of.indices.to_numpy(), pc.array_sort_indices(of.dictionary).to_numpy()
        counts = np.concatenate([_unzip_counts(c) for c in own["c"].to_pylist()], axis=1)
        c1, c2 = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        np.add.at(c1, at, counts[0])
        np.add.at(c2, at, counts[1])
        ends = [*range(PACK_ROWS, len(order), PACK_ROWS), len(order)]
        for i, j, k in zip([0, *ends], ends, _joined(of.dictionary.take(pa.array(order)), ends)):
            out.append((part, model.as_py(), k, _zip_counts(c1[order[i:j]], c2[order[i:j]])))
    return _packed_rows(out)


def _by_model(batches, block_chars: int, each: int = 0):
    """``(model, rows)``: rows (columns ``_model, _t, ...``) of one model, of up to ``block_chars`` characters of ``_t`` and ``each`` a row."""
    held: dict = {}
    for batch in batches:
        models = batch.column(0).dictionary_encode(null_encoding="encode")
        codes, sizes = models.indices.to_numpy(), each + pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        for code, model in enumerate(models.dictionary.to_pylist()):
            mine = np.flatnonzero(codes == code)
            upto, done = np.cumsum(sizes[mine]), 0
            while done < len(mine):
                got = held.setdefault(model, [[], 0])
                before = int(upto[done - 1]) if done else 0
                cut = min(len(mine), int(np.searchsorted(upto, block_chars - got[1] + before)) + 1)
                got[0].append(batch.take(pa.array(mine[done:cut])))
                got[1] += int(upto[cut - 1]) - before
                done = cut
                if got[1] >= block_chars:
                    yield model, pa.Table.from_batches(held.pop(model)[0])
    for model, got in held.items():
        yield model, pa.Table.from_batches(got[0])


def _text(rows: pa.Table) -> pa.Array:
    return pa.concat_arrays(rows["_t"].chunks)


def _model_id(keys: list[str]):
    """The row's model as one string (NULL if a key is)."""
    return F.col(keys[0]).cast("string") if len(keys) == 1 else F.concat(F.lit(""), *[F.md5(F.col(k).cast("string")) for k in keys])


def fit_bigram(train: DataFrame, text_col: str = "text", keys: tuple = ()) -> BigramLM:
    """M1 (fit): blocks of texts count their distinct words and pairs and send them packed to the parts of the
    model, which sum them up: what is shuffled are lists, not a row for every word and pair.

    With ``keys``, one model for each of their values (no NULLs), all in the same tables.
    """
    keys = list(keys)
    chars = train.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0  # about: a length is there, characters are counted
    grown = max(1.0, math.sqrt(chars / GROWS_FROM))
    parts, block = max(shuffle_partitions(train.sparkSession), int(chars / (PART_CHARS * grown)) + 1), int(BLOCK_CHARS * grown)
    # texts without a word are left out below: a condition on the column would make it twice
    texts = train.select(_model_id(keys).alias("_model"), lm_text(text_col).alias("_t")).filter(F.col("_model").isNotNull())

    def count(batches):
        for model, rows in _by_model((b.filter(pc.greater(pc.binary_length(b.column(1)), 0)) for b in batches), block):
            own = _Block(_text(rows), parts)
            c1, c2 = own.counts()
            yield from _packed_rows([(part, model, k, _zip_counts(c1[i:j], c2[i:j])) for part, i, j, k in own.lists()]).to_batches()

    # the model is a stage output: stored once, re-read by every scoring
    # in buckets of its parts, so the rounds of a scoring don't deal it again
    table = cut_lineage(texts.mapInArrow(count, PACKED).groupBy("_part").applyInArrow(_merge, PACKED),
                        "_part", min(shuffle_partitions(train.sparkSession), MAX_BUCKETS))
    rows = table.mapInArrow(_totals, "_model string, n long, v long").groupBy("_model")
    den = rows.agg((F.sum("n") + F.sum("v") + 1).cast("double").alias("denom"))
    if keys:
        names = train.select(*keys).distinct().withColumn("_model", _model_id(keys)).dropDuplicates(["_model"])
        den = names.join(den, "_model")
    return BigramLM(table, cut_lineage(den.select(*keys, "_model", "denom")), parts, block, tuple(keys))


def _totals(batches):
    """Tokens and distinct words in packed rows."""
    for batch in batches:
        for r in batch.to_pylist():
            k = _keys([r["k"]])
            word = ~pc.match_substring(k, " ").to_numpy(zero_copy_only=False)
            yield from _rows([(r["_model"], int(_unzip_counts(r["c"])[0][word].sum()), int(word.sum()))], ("_model", pa.string()), ("n", pa.int64()), ("v", pa.int64())).to_batches()


def _with_p1(df: DataFrame, lm: BigramLM) -> DataFrame:
    """Add ``p1``, the unigram probability of ``w`` (column ``c_w``, NULL: unseen) in the row's model.
    A model without training text has N = V = 0."""
    if lm.keys:
        j = df.join(lm.denominators.drop("_model"), list(lm.keys), "left")
        denom = F.coalesce("denom", F.lit(1.0))
    else:
        total = lm.denominators.first()  # one scalar
        j, denom = df, F.lit(total["denom"] if total else 1.0)
    return j.withColumn("p1", (F.coalesce(F.col("c_w"), F.lit(0)) + 1.0) / denom).drop("denom")


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Counts of the keys that blocks ask for in one part of the model; 0 where it has none. Rows without a block have N + V + 1."""
    out, told = [], pc.is_null(asked["_block"])
    totals = {r["_model"]: _unzip_counts(r["k"]) for r in asked.filter(told).to_pylist()}
    asked = asked.filter(pc.invert(told))
    for name in pc.unique(asked["_model"]):
        rows = asked.filter(pc.equal(asked["_model"], name)).to_pylist()
        mine = model.filter(pc.equal(model["_model"], name))
        total = totals.get(name.as_py())
        known = pa.concat_arrays([_keys(mine["k"].to_pylist()), pa.array([TOTAL] * (total is not None), pa.large_string())])
        counts = np.concatenate([*[_unzip_counts(c) for c in mine["c"].to_pylist()], *([] if total is None else [total]), np.zeros((2, 0), np.int64)], axis=1)
        keys, ends = _split([r["k"] for r in rows])
        of = keys.dictionary_encode()
        # the model's keys are looked up among those of this round, which are fewer
        at = pc.index_in(known, value_set=of.dictionary)
        met = at.is_valid().to_numpy(zero_copy_only=False)
        found, code = np.zeros((2, len(of.dictionary)), np.int64), of.indices.to_numpy()
        found[:, at.drop_null().to_numpy()] = counts[:, met]
        for r, i, j in zip(rows, [0, *ends[:-1]], ends, strict=True):
            out.append((r["_block"], r["_part"], _zip_counts(*found[:, code[i:j]])))
    return _rows(out, ("_block", pa.string()), ("_part", pa.int32()), ("c", pa.binary()))


def _block(r: dict, parts: int) -> _Block:
    return _Block(_keys([r["texts"]]).cast(pa.string()), parts, (TOTAL,))


def _asked_rows(rows: list[tuple]):
    return _rows(rows, ("_part", pa.int32()), ("_block", pa.string()), ("_model", pa.string()), ("k", pa.binary())).to_batches()


def _total_rows(batches, parts: int):
    """N + V + 1 of every model, for the part in which TOTAL is asked for."""
    for batch in batches:
        yield from _asked_rows([(_total_part(parts), None, r["_model"], _zip_counts(np.array([r["denom"]]), np.zeros(1))) for r in batch.to_pylist()])


ASKED = "_part int, _block string, _model string, k binary"
BLOCK = "_block string, _model string, n int, texts binary, rows binary"


def _sealed(model, rows: pa.Table):
    """One block: its distinct texts, and its rows with the places of theirs (-1: no text to score)."""
    of = _text(rows).dictionary_encode()
    table = rows.drop_columns(rows.column_names[:2]).append_column("_at", of.indices.fill_null(-1))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.combine_chunks())
    fields = ("_block", pa.string()), ("_model", pa.string()), ("n", pa.int32()), ("texts", pa.binary()), ("rows", pa.binary())
    n = len(of.dictionary)
    return _rows([(uuid.uuid4().hex, model, n, _joined(of.dictionary, [n])[0], sink.getvalue().to_pybytes())], *fields).to_batches()


def _seal(batches, block_chars: int):
    """Rows of one model to blocks of up to ``block_chars``, the unit in which pairs are asked for and scored."""
    for model, rows in _by_model(batches, block_chars, 64):
        yield from _sealed(model, rows)


def score_bigram(df: DataFrame, lm: BigramLM, text_col: str = "text", out: str = "response",
                 context_col: str | None = None, decimals: int | None = 9, keep: list[str] | None = None, read=None) -> DataFrame:
    """M1 (apply) + M3: the rows of ``df`` (columns ``keep``, or all) with the bigram response of their text.

    Rows are packed into blocks, each distinct text of a block once (memoised like a score cache); a block asks each
    part of the model for its distinct words and pairs in one packed row, the part answers with their counts, and the
    block sums up its texts: what is shuffled are lists, not a row for every pair. The blocks do so in rounds, so that
    the lists of a round are all that is dealt at a time. Blocks and answers are removed
    when the responses are stored; ``read()`` is called when ``df`` has been read.
    With a context, its last token is the predecessor of the first text token
    (conditioned on, not scored); a NULL context is a context of its own. A NULL
    text, or one without a pair, has no response. A keyed model scores each row with
    the model that the row's key columns name.
    """
    spark, parts, size = df.sparkSession, lm.parts, lm.block_chars
    text = lm_text(text_col)
    if context_col:
        last_ctx = F.slice(F.coalesce(lm_tokens(context_col), F.array().cast("array<string>")), -1, 1)
        text = F.array_join(F.concat(last_ctx, lm_tokens(text_col)), " ")
    model, columns = _model_id(list(lm.keys)), df.columns if keep is None else keep
    rows = df.select(model.alias("_model"), text.alias("_t"), *columns)
    rows = rows.withColumn("_t", F.when(F.col("_model").isNotNull() & F.col("_t").contains(" "), F.col("_t")))
    shape = T.StructType([*rows.schema.fields[2:], T.StructField(out, T.DoubleType())])

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _asked_rows([(part, r["_block"], r["_model"], k) for part, _, _, k in _block(r, parts).lists()])

    def respond(own: pa.Table, answers: pa.Table) -> pa.Table:
        r = own.to_pylist()[0]
        mine = pa.ipc.open_stream(r["rows"]).read_all()
        values = np.array([np.nan])  # of place -1
        if r["n"]:
            c1, c2 = np.concatenate([_unzip_counts(c) for c in answers.sort_by("_part")["c"].to_pylist()], axis=1)
            values = np.r_[_block(r, parts).responses(c1, c2), values]
        at = mine["_at"].to_numpy()
        return mine.drop_columns(["_at"]).append_column(out, pa.array(values[at], pa.float64(), mask=at < 0))

    with recorded_stages() as passing:
        blocks = cut_lineage(rows.mapInArrow(lambda batches: _seal(batches, size), BLOCK))
        if read:
            read()
    totals = lm.denominators.mapInArrow(lambda batches: _total_rows(batches, parts), ASKED)
    rounds, stored = max(1, min(ROUNDS, blocks.count() // (2 * spark.sparkContext.defaultParallelism))), []
    for i in range(rounds):
        mine = blocks.filter(F.crc32("_block") % rounds == i)
        with recorded_stages() as told:
            asked = mine.filter("n > 0").select("_block", "_model", "texts").mapInArrow(ask, ASKED).unionAll(totals)
            answers = cut_lineage(asked.groupBy("_part").cogroup(lm.packed.groupBy("_part")).applyInArrow(_answer, "_block string, _part int, c binary"))
        resp = mine.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(respond, shape)
        stored.append(cut_lineage(resp if decimals is None else resp.withColumn(out, F.round(out, decimals))))
        remove_stages(spark, told)
    remove_stages(spark, passing)
    return reduce(DataFrame.unionAll, stored)


def ngram_counts(lm: BigramLM) -> DataFrame:
    """Bigram table with its conditional probability (inspection / export)."""
    keys = list(lm.keys)
    counted = lm.bigrams.join(lm.prefixes, [*keys, "u"]).join(lm.unigrams, [*keys, "w"])
    return (_with_p1(counted, lm)
            .select(*keys, "u", "w", "c_uw", "c_u", "c_w",
                    ((F.col("c_uw") + F.lit(BETA) * F.col("p1")) / (F.col("c_u") + F.lit(BETA))).alias("p_w_given_u")))


def with_cache(df: DataFrame, cache: DataFrame, scorer, text_col: str = "text",
               out: str = "response") -> DataFrame:
    """Response from the cache by normalised text; misses go to ``scorer``.

    One left join on ``sent_key``; the misses (anti side) are scored and unioned.
    ``cache``: ``sent_key, response``. ``scorer``: DataFrame -> DataFrame adding ``out``.
    """
    keyed = df.withColumn("sent_key", cache_key(text_col))
    # one row per key whatever the cache holds; the aggregation shares the join's partitioning
    c = cache.groupBy("sent_key").agg(F.min("response").alias("_cached"))
    j = keyed.join(c, "sent_key", "left")
    hits = (j.filter(F.col("_cached").isNotNull()).withColumn(out, F.col("_cached")).drop("_cached")
            .withColumn("from_cache", F.lit(True)))
    miss = scorer(j.filter(F.col("_cached").isNull()).drop("_cached")).withColumn("from_cache", F.lit(False))
    return hits.unionByName(miss)


def cache_misses(df: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose normalised text is not in the cache (left anti join)."""
    return df.withColumn("sent_key", cache_key(text_col)).join(cache.select("sent_key"), "sent_key", "left_anti")


_SCORERS: dict = {}


def score_with(df: DataFrame, make_scorer, text_col: str = "text", out: str = "response",
               context_col: str | None = None, batch_rows: int = 256) -> DataFrame:
    """Score distinct texts with the user's model in Arrow batches.

    ``make_scorer()`` is called once per Python worker and must return a
    function ``(list[str], list[str|None]) -> list[float]``. Only distinct texts
    are sent, so repeated sentences are scored once.
    """
    key_cols = [text_col] + ([context_col] if context_col else [])
    texts = df.select(*key_cols).distinct()
    factory_id = uuid.uuid4().hex  # a worker may be reused by a later call with another model
    schema = T.StructType([*[texts.schema[c] for c in key_cols], T.StructField(out, T.DoubleType())])

    def run(batches):
        fn = _SCORERS.get(factory_id)
        if fn is None:
            fn = _SCORERS[factory_id] = make_scorer()
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                part = pdf.iloc[start:start + batch_rows]
                ctx = part[context_col].tolist() if context_col else [None] * len(part)
                vals = fn(part[text_col].tolist(), ctx)
                res = part[key_cols].copy()
                res[out] = pd.Series(vals, index=part.index, dtype="float64")
                yield res

    return null_safe_join(df, texts.mapInPandas(run, schema), key_cols, "left")
