"""Human / machine text pairs in one schema.

``load_pairs`` renames the two text columns of any table to ``human_text`` /
``machine_text`` (and an optional third to ``text``) and adds a dense ``id``
when the table has none. The registry names the published datasets and their
field mapping; paths are local tables (no download).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authorscan.functions.text import sentence_pieces
from authorscan.operators.scan import row_index

# Dataset name -> (machine field, human field, split).
PAIR_REGISTRY = {
    "wiki-intro": ("generated_intro", "wiki_intro", "train"),
    "wiki-intro-long": ("generated_intro", "wiki_intro", "train"),
    "research-abstracts": ("generated_abstract", "real_abstract", "train"),
    "news-long": ("chatgpt", "article", "train"),
    "news": ("chatgpt", "article", "train"),
    "wikibio": ("gpt3_text", "wiki_bio_text", "evaluation"),
    "alpaca": ("output", "instruction", "train"),
}
SHUFFLE_SEED = 42   # fixed value: seed of the published loaders
LONG_SENTENCES = 15  # fixed value: least sentences of a generated article in the long sets


def load_pairs(df: DataFrame, machine_field: str, human_field: str, text_field: str | None = None,
               order=None, shuffle: bool = False) -> DataFrame:
    """Common schema ``id, human_text, machine_text[, text]``.

    ``id`` is added only when absent: a dense 0-based index in ``order`` (default: the
    order of the rows as they are read). With ``shuffle``, ``shuffle_rank`` is the row's place in the seeded
    shuffle: the order of md5(id | seed), the same however the rows are partitioned.
    """
    out = df.withColumnsRenamed({human_field: "human_text", machine_field: "machine_text"})
    if text_field:
        out = out.withColumnRenamed(text_field, "text")
    if "id" not in out.columns:
        out = out.withColumn("_one", F.lit(1)).withColumn("_row", F.monotonically_increasing_id())
        out = row_index(out, ["_one"], list(order or ["_row"]), "id").drop("_one", "_row")
    if shuffle:
        h = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(SHUFFLE_SEED))))
        out = row_index(out.withColumn("_one", F.lit(1)).withColumn("_h", h), ["_one"], ["_h", "id"], "shuffle_rank").drop("_one", "_h")
    return out


def load_registered(df: DataFrame, name: str, split_col: str = "split", long_form: bool = False, shuffle: bool = False, order=None) -> DataFrame:
    """A registered dataset.

    Its split with an ``id``; or in ``long_form`` (the local variants of the long sets) every split, no id
    added, and only rows whose machine text has at least 15 sentences.
    """
    machine, human, split = PAIR_REGISTRY[name]
    if long_form:
        long = F.size(F.filter(sentence_pieces(machine), lambda p: F.rlike(p, F.lit(r"\S")))) >= LONG_SENTENCES
        return df.filter(long).withColumnsRenamed({human: "human_text", machine: "machine_text"})
    if split_col not in df.columns:
        raise ValueError(f"{name} is registered for split {split!r}, but the data has no column {split_col!r}")
    return load_pairs(df.filter(F.col(split_col) == split), machine, human, order=order, shuffle=shuffle)


def read_registered(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **kw) -> DataFrame:
    """``load_registered`` of a local table; CSV with a header, JSON lines or Parquet."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", fmt == "csv")
    return load_registered(reader.format(fmt).load(path), name, **kw)


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Driver table ``conversations``: a user turn is the human text, the assistant
    turn right after it the machine text."""
    u = conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("human_text"))
    a = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("machine_text"))
    pairs = u.join(a, ["conv_id", "turn"])
    return load_pairs(pairs, "machine_text", "human_text", order=["conv_id", "turn"])


def pairs_long(pairs: DataFrame) -> DataFrame:
    """Long form ``id, author (human / machine), text``."""
    return pairs.select("id", F.explode(F.array(
        F.struct(F.lit("human").alias("author"), F.col("human_text").alias("text")),
        F.struct(F.lit("machine").alias("author"), F.col("machine_text").alias("text")))).alias("r")).select(
        "id", "r.author", "r.text")
