"""Corpus operators: sentences, article atoms, edit budgets, fixed-length articles,
rendering, counts, context and ``<edit>`` tag spans.

All per-document ordered logic (running counts, budgets, prefix cuts, tag state)
goes through :func:`authorscan.operators.scan.scan`, so a single huge document is
split across tasks instead of landing in one window partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorscan.functions.text import sentence_pieces, strip_ws, word_count
from authorscan.operators.scan import Acc, scan
from authorscan.params import Params

# Atom tags.
TAG_ORIGINAL = "no edits"
TAG_EDIT = "<edit>"


def split_sentences(docs: DataFrame, id_cols=("doc_id",), text_col: str = "text",
                    mode="punct", keep=()) -> DataFrame:
    """T3 + T1: one row per non-empty sentence piece.

    Output: ``id_cols, keep, pos (0-based piece index, gaps kept), text, length``.
    """
    sel = [F.col(c) for c in (*id_cols, *keep)]
    # stripped in the array: a column of its own would be stripped twice, for the filter too
    pieces = F.transform(sentence_pieces(text_col, mode), strip_ws)
    return (docs.select(*sel, F.posexplode(pieces).alias("pos", "text"))
            .filter(F.col("text") != "")
            .withColumn("length", word_count("text")))


@dataclass(frozen=True)
class Setting:
    """One version of every article: the original, or one with a budget of edits; ``max_sentences`` cuts it.
    A column's name in place of a number takes each row's own."""

    edited: int
    edit_ratio: float | str | None = None
    max_sentences: int | str | None = None


def candidate_atoms(sentences: DataFrame, params: Params, doc_keys=("topic", "doc_id")) -> DataFrame:
    """F1 W1 (one scan): every sentence and alternative of min..max words, with the running counts from which
    the atoms of any edit ratio and article size follow (:func:`atoms_of`).

    Input: one row per article sentence ``doc_keys, pos, sentence, alternative``
    (optional ``context``, ``alternative_context``, and ``length``, ``alternative_length`` in words), ``pos`` ordering the article.
    Output: ``doc_keys, pos, kind (0 original / 1 alternative), text, length, context, tag`` and the counts
    ``orig_before, alt_before`` (eligible ones before the sentence), ``orig_here``, ``orig_total, alt_total``,
    ``n_sentences, n_alternatives`` (all of the article).
    """
    lo, hi = params.min_tokens, params.max_tokens
    keys = list(doc_keys)
    cols = set(sentences.columns)
    s = with_lengths(sentences).withColumnsRenamed({"length": "_olen", "alternative_length": "_alen"})
    flags = {"_orig_ok": F.col("_olen").between(lo, hi).cast("int"),
             "_has_alt": F.col("alternative").isNotNull().cast("int"),
             "_alt_ok": (F.col("alternative").isNotNull() & F.col("_alen").between(lo, hi)).cast("int")}
    accs = []
    for name, col in {"_one": F.lit(1), **flags}.items():
        accs += [Acc(f"{name}_b", "sum", col, "before")] * (name in ("_orig_ok", "_alt_ok")) + [Acc(f"{name}_n", "sum", col, "all")]
    s = scan(s, keys, ["pos"], accs).withColumns(flags)
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    counts = [z("_orig_ok_b").alias("orig_before"), z("_alt_ok_b").alias("alt_before"),
              F.coalesce("_orig_ok", F.lit(0)).cast("long").alias("orig_here"),
              z("_orig_ok_n").alias("orig_total"), z("_alt_ok_n").alias("alt_total"),
              z("_one_n").alias("n_sentences"), z("_has_alt_n").alias("n_alternatives")]
    return s.select(*keys, "pos", *counts, _inline_atoms(cols, "_olen", "_alen", F.col("_orig_ok") == 1, F.col("_alt_ok") == 1)).drop("_keep")


def _inline_atoms(cols: set, olen: str, alen: str, orig_ok, alt_ok):
    """The row's sentence and alternative, as rows."""
    def atom(kind, text, length, context, tag, keep):
        context = F.col(context) if context in cols else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), F.col(text).alias("text"), F.col(length).alias("length"),
                        context.alias("context"), F.lit(tag).alias("tag"), keep.alias("_keep"))

    atoms = F.array(atom(0, "sentence", olen, "context", TAG_ORIGINAL, orig_ok),
                    atom(1, "alternative", alen, "alternative_context", TAG_EDIT, alt_ok))
    return F.inline(F.filter(atoms, lambda a: a["_keep"]))


def with_lengths(sentences: DataFrame) -> DataFrame:
    """``length`` and ``alternative_length`` in words, counted where they are not there yet."""
    missing = {"length": "sentence", "alternative_length": "alternative"}
    return sentences.withColumns({c: word_count(t) for c, t in missing.items() if c not in sentences.columns})


def eligible_atoms(sentences: DataFrame, params: Params, keys) -> DataFrame:
    """The rows of :func:`candidate_atoms` without their counts (no scan): ``keys, pos, kind, text, length, context, tag``."""
    lo, hi = params.min_tokens, params.max_tokens
    s = with_lengths(sentences)
    return s.select(*keys, "pos", _inline_atoms(set(sentences.columns), "length", "alternative_length", F.col("length").between(lo, hi),
                                                F.col("alternative").isNotNull() & F.col("alternative_length").between(lo, hi))).drop("_keep")


COUNTS = ("orig_before", "alt_before", "orig_here", "orig_total", "alt_total", "n_sentences", "n_alternatives")


def atoms_of(candidates: DataFrame, settings: list[Setting]) -> DataFrame:
    """The atoms of every setting, from the candidates' counts alone (no shuffle).

    The counts make way for ``setting`` (its place in the list), ``edited`` and ``atom_no``. The edit budget is
    floor(n_sentences * edit_ratio) over all sentences of the article (the number of alternatives when the
    ratio is None); only eligible alternatives use it, in document order. With ``max_sentences`` an article
    keeps the sentences up to the one at which its atom count reaches the maximum and is dropped if it never does.
    """
    alt = F.col("kind") == 1
    versions = []
    for i, s in enumerate(settings):
        before, total, keep = F.col("orig_before"), F.col("orig_total"), ~alt
        if s.edited:
            budget = (F.col("n_alternatives") if s.edit_ratio is None
                      else F.floor(F.col("n_sentences") * (F.col(s.edit_ratio) if isinstance(s.edit_ratio, str)
                                                           else F.lit(float(s.edit_ratio)))).cast("long"))
            before = before + F.least(F.col("alt_before"), budget)
            total = total + F.least(F.col("alt_total"), budget)
            keep = ~alt | (F.col("alt_before") + 1 <= budget)
        if s.max_sentences:
            most = F.col(s.max_sentences) if isinstance(s.max_sentences, str) else F.lit(int(s.max_sentences))
            keep = keep & (before < most) & (total >= most)
        no = (before + 1 + F.when(alt, F.col("orig_here")).otherwise(0)).cast("int")
        versions.append(F.struct(F.lit(i).alias("setting"), F.lit(int(s.edited)).alias("edited"), no.alias("atom_no"), keep.alias("_keep")))
    rest = [c for c in candidates.columns if c not in COUNTS]
    return candidates.select(*rest, F.inline(F.filter(F.array(*versions), lambda v: v["_keep"]))).drop("_keep")


def article_atoms(sentences: DataFrame, params: Params, doc_keys=("topic", "doc_id"),
                  versions=(0, 1)) -> DataFrame:
    """Article sentences -> tagged atoms of one edit ratio and size.

    Output: ``doc_keys, pos, edited, kind (0 original / 1 alternative), text, length,
    context, tag, atom_no`` for every requested version (0 = original article,
    1 = article with the budgeted edits inserted after their sentence).
    """
    settings = [Setting(v, params.edit_ratio, params.max_sentences) for v in versions]
    atoms = atoms_of(candidate_atoms(sentences, params, doc_keys), settings)
    return atoms.select(*doc_keys, "pos", "edited", "kind", "text", "length", "context", "tag", "atom_no")


def atoms_per_document(atoms: DataFrame, doc_keys=("topic", "doc_id", "edited")) -> DataFrame:
    """A11 + counts: atoms, edits and realised edit rate per document version."""
    return (atoms.groupBy(*doc_keys)
            .agg(F.count(F.lit(1)).alias("n_atoms"),
                 F.sum((F.col("tag") == TAG_EDIT).cast("int")).alias("n_edits"),
                 F.avg((F.col("tag") == TAG_EDIT).cast("double")).alias("edit_rate")))


def previous_context(atoms: DataFrame, doc_keys=("topic", "doc_id", "edited"),
                     order: str = "atom_no", fixed: str | None = None) -> DataFrame:
    """``context`` = text of the previous atom of the same document (or a fixed text).

    A dense atom number makes the lag an equi join on ``(doc, atom_no - 1)``:
    rows of a huge document hash to many partitions.
    """
    if fixed is not None:
        return atoms.withColumn("context", F.lit(fixed))
    keys = list(doc_keys)
    prev = atoms.select(*keys, (F.col(order) + 1).alias(order), F.col("text").alias("context"))
    return atoms.drop("context").join(prev, [*keys, order], "left")


def tag_spans(texts: DataFrame, id_cols=("doc_id",), text_col: str = "text",
              min_chars: int = 3) -> tuple[DataFrame, DataFrame]:
    """Split tagged text into pieces inside / outside ``<edit>…</edit>``.

    Returns ``(spans, quarantine)``. ``spans``: ``id_cols, piece_no, text, tag``
    (tag ``<edit>`` inside a pair, NULL outside); pieces shorter than
    ``min_chars`` characters after trimming are dropped. ``quarantine``: documents
    whose tags do not balance (state leaves {0, 1} or does not end at 0) with the
    piece number of the first violation.
    """
    keys = list(id_cols)
    tok = texts.select(*keys, F.posexplode(
        F.regexp_extract_all(F.col(text_col), F.lit(r"</?edit>|[^<]+|<"), 0)).alias("piece_no", "tok"))
    tok = tok.withColumn("_d", F.when(F.col("tok") == "<edit>", 1).when(F.col("tok") == "</edit>", -1).otherwise(0))
    tok = scan(tok, keys, ["piece_no"], [Acc("state", "sum", "_d", "upto"),
                                         Acc("_rest", "sum", "_d", "after")])
    tok = tok.withColumn("state", F.coalesce("state", F.lit(0)))
    total = F.col("state") + F.coalesce("_rest", F.lit(0))
    bad_row = (F.col("state") < 0) | (F.col("state") > 1) | (total != 0)
    quarantine = (tok.filter(bad_row).groupBy(*keys)
                  .agg(F.min("piece_no").alias("first_bad_piece")))
    good = tok.join(quarantine.select(*keys), keys, "left_anti")
    spans = (good.filter(F.col("_d") == 0)
             .withColumn("text", strip_ws("tok"))
             .filter(F.length("text") >= min_chars)
             .withColumn("tag", F.when(F.col("state") == 1, F.lit(TAG_EDIT)))
             .select(*keys, "piece_no", "text", "tag"))
    return spans, quarantine
