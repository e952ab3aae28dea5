"""Article sources (S1 S2 S3 S16 A1) and the article fixture derived from ``documents``.

An article is one row: ``title`` -> ``sub_titles[]`` -> ``sentences[]`` of
``{sentence, alternative?, context?, alternative_context?}``. Stored as a JSON
string column ``article_json`` in CSV files laid out ``topic/edit_ratio_{r}/topic.csv``
(accuracy runs) or ``topic/{n}_sentences/{r}/topic.csv`` (power runs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authorscan.operators.corpus import split_sentences
from authorscan.operators.scan import row_index

SENTENCE_T = T.StructType([
    T.StructField("sentence", T.StringType()),
    T.StructField("alternative", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("alternative_context", T.StringType()),
])
SUBTITLE_T = T.StructType([
    T.StructField("sub_title", T.StringType()),
    T.StructField("sentences", T.ArrayType(SENTENCE_T)),
])
ARTICLE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("sub_titles", T.ArrayType(SUBTITLE_T)),
])

# Fixed values of the fixture recipe (FIXTURES.md §3).
LM_FOLDS = 2   # cross-fit folds of the language models: every sentence trains one model and is scored by another
ALT_EVERY = 3  # article sentences with pos % 3 = 1 get the donor's sentence at the same pos
BLOCK = 10     # sub-title = block of 10 positions


def lm_model(fold) -> Column:
    """Name of the language model of the row's language (NULL: a language of its own) for a cross-fit fold."""
    return F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), F.pmod(fold, F.lit(LM_FOLDS)).cast("string"))


def document_sentences(documents: DataFrame) -> DataFrame:
    """Sentences of every document with source, the model that scores them and the one that they train.

    A document of fold ``doc_id mod LM_FOLDS`` is scored by its language's model of that fold,
    which the next fold's documents train: nothing is scored by a model that has seen it.
    """
    docs = (documents.withColumn("model", lm_model(F.col("doc_id")))
            .withColumn("trains", lm_model(F.col("doc_id") - 1)))
    return split_sentences(docs, ("doc_id",), "text", "punct", keep=("source", "model", "trains"))


def lm_training_sentences(sentences: DataFrame) -> DataFrame:
    """All sentences, under the model that they train."""
    return sentences.select(F.col("trains").alias("model"), "text")


def donor_pairs(documents: DataFrame) -> DataFrame:
    """``doc_id, donor_id``: every document's donor, a document of another language.

    Documents are numbered by (language, doc_id); the documents of one language are dealt in turn
    to all documents of the others, starting behind the language's own run. A donor serves
    ceil(documents of the language / documents of the others) documents of a language at most.
    ``donor_id`` is NULL where all documents are of one language.
    """
    docs = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("_lang"), F.lit(0).alias("_all"))
    ranked = row_index(docs, ["_all"], ["_lang", "doc_id"], out="_g").drop("_all")
    total = F.lit(ranked.count())
    runs = ranked.groupBy("_lang").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n"))
    others = total - F.col("_n")
    turn = F.col("_first") + F.col("_n") + (F.col("_g") - F.col("_first")) % others
    asked = ranked.join(runs, "_lang").select("doc_id", F.when(others > 0, turn % total).alias("_g"))
    return asked.join(ranked.select("_g", F.col("doc_id").alias("donor_id")), "_g", "left").drop("_g")


def takes_alternative() -> Column:
    """The sentences that take an alternative, and that are one for other documents."""
    return F.col("pos") % ALT_EVERY == 1


def fixture_article_sentences(sentences: DataFrame, documents: DataFrame) -> DataFrame:
    """Flat article table: ``topic, doc_id, model, pos, sentence, length, alternative, alternative_length``.

    Every document is an article (topic = source); the alternative of a sentence with
    pos % 3 = 1 is the sentence at the same position of the document's donor, if any.
    Only those sentences are joined.
    """
    art = sentences.select(F.col("source").alias("topic"), "doc_id", "model", "pos", F.col("text").alias("sentence"), "length")
    chosen = takes_alternative()
    donated = sentences.filter(chosen).select(F.col("doc_id").alias("donor_id"), "pos", F.col("text").alias("alternative"),
                                              F.col("length").alias("alternative_length"))
    edited = (art.filter(chosen).join(donor_pairs(documents), "doc_id", "left")
              .join(donated, ["donor_id", "pos"], "left").drop("donor_id"))
    none = {"alternative": F.lit(None).cast("string"), "alternative_length": F.lit(None).cast("int")}
    return edited.unionByName(art.filter(~chosen).withColumns(none))


def build_articles(flat: DataFrame, doc_keys=("topic", "doc_id")) -> DataFrame:
    """Nested article per document (one row per article, the reference's unit of storage)."""
    keys = list(doc_keys)
    cols = set(flat.columns)
    sent = F.struct(
        F.col("sentence"), F.col("alternative"),
        (F.col("context") if "context" in cols else F.lit(None).cast("string")).alias("context"),
        (F.col("alternative_context") if "alternative_context" in cols
         else F.lit(None).cast("string")).alias("alternative_context"))
    blocks = (flat.groupBy(*keys, F.floor(F.col("pos") / BLOCK).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct(F.col("pos"), sent.alias("s")))).alias("ss"))
              .select(*keys, "block", F.struct(
                  F.concat(F.lit("part "), F.col("block").cast("string")).alias("sub_title"),
                  F.transform("ss", lambda x: x["s"]).alias("sentences")).alias("st")))
    return (blocks.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("block", "st"))).alias("bs"))
            .select(*keys, F.struct(
                F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
                F.transform("bs", lambda x: x["st"]).alias("sub_titles")).alias("article")))


def to_article_json(articles: DataFrame) -> DataFrame:
    return articles.withColumn("article_json", F.to_json("article")).drop("article")


def parse_articles(df: DataFrame, json_col: str = "article_json") -> tuple[DataFrame, DataFrame]:
    """T4: parse ``article_json`` with the fixed schema; unparsable rows -> quarantine."""
    parsed = df.withColumn("article", F.from_json(F.col(json_col), ARTICLE_SCHEMA,
                                                  {"mode": "PERMISSIVE"}))
    bad = parsed.filter(F.col("article").isNull() | F.col("article.sub_titles").isNull())
    good = parsed.filter(F.col("article").isNotNull() & F.col("article.sub_titles").isNotNull())
    return good.drop(json_col), bad.drop("article")


LAYOUTS = {  # path pattern and the keys that it names
    "accuracy": (r"([^/]+)/edit_ratio_([^/]+)/[^/]+$", {"topic": "string", "edit_ratio": "double"}),
    "lines": (r"topic=([^/]+)/edit_ratio=([^/]+)/[^/]+$", {"topic": "string", "edit_ratio": "double"}),  # of write_article_lines
    "power": (r"([^/]+)/([0-9]+)_sentences/([^/]+)/[^/]+$", {"topic": "string", "number_sentence": "int", "edit_ratio": "double"}),
}


NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def _unescaped(part: Column) -> Column:
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def read_articles(spark: SparkSession, paths, layout: str = "accuracy", fmt: str = "csv",
                  multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Read article files, one JSON article per row: ``(articles, quarantine)``.

    ``fmt``: ``csv`` with a column ``article_json``, or ``jsonl`` (one article object a line). JSON text holds no line
    break, so a row is a line and large files of both kinds are split among tasks; ``multi_line`` reads
    CSV whose quoted fields do hold line breaks (one task a file then). ``topic``, ``edit_ratio`` (and
    ``number_sentence`` for the power layout) come from the path; ``article_index`` is the row's number in its file.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(paths)
    elif fmt == "jsonl":
        raw = spark.read.text(paths).filter(F.col("value") != "").withColumnRenamed("value", "article_json")
    else:
        raise ValueError(f"unknown article format {fmt!r}")
    # rows of a split are numbered in order, and splits of a file by where they begin
    raw = raw.select("article_json", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
                     F.monotonically_increasing_id().alias("_seen"))
    pattern, types = LAYOUTS.get(layout, (None, {}))
    for i, (key, kind) in enumerate(types.items()):
        part = _unescaped(F.regexp_extract("_path", pattern, i + 1))
        if layout == "lines":  # partition folders are escaped names; the one of NULL is Spark's
            part = F.when(part != NULL_FOLDER, _unescaped(part))
        raw = raw.withColumn(key, part.cast(kind))
    raw = row_index(raw, [*types], ["_path", "_start", "_seen"], "article_index").drop("_start", "_seen", "_path")
    return parse_articles(raw)


def write_article_lines(articles: DataFrame, path: str) -> None:
    """Articles as JSON lines partitioned by topic and edit ratio (layout ``lines``, format ``jsonl``), in ``article_index`` order."""
    (to_article_json(articles.select("topic", "edit_ratio", "article_index", "article")).withColumnRenamed("article_json", "value")
     .repartitionByRange("topic", "edit_ratio", "article_index").sortWithinPartitions("topic", "edit_ratio", "article_index")
     .drop("article_index").write.mode("overwrite").partitionBy("topic", "edit_ratio").text(path))


def explode_articles(articles: DataFrame, doc_keys=("topic", "doc_id")) -> DataFrame:
    """Nested articles -> flat sentence rows (``pos`` = sentence index in the article)."""
    flat = F.flatten(F.transform("article.sub_titles", lambda s: s["sentences"]))
    return (articles.select(*doc_keys, F.posexplode(flat).alias("pos", "s"))
            .select(*doc_keys, "pos", "s.sentence", "s.alternative", "s.context", "s.alternative_context"))


def article_counts(articles: DataFrame, doc_keys=("topic", "doc_id")) -> DataFrame:
    """A1: sentences and alternatives per article (array elements, not substrings)."""
    flat = F.flatten(F.transform("article.sub_titles", lambda s: s["sentences"]))
    return articles.select(*doc_keys,
                           F.size(flat).alias("n_sentences"),
                           F.size(F.filter(flat, lambda x: x["alternative"].isNotNull())).alias("n_alternatives"),
                           F.size("article.sub_titles").alias("n_sub_titles"))


def render_articles(articles: DataFrame, edited: bool = False, doc_keys=("topic", "doc_id"),
                    tag_edits: bool = False) -> DataFrame:
    """Article -> plain text: title line, ``\\n==sub_title==`` lines, one sentence
    per line; in edited mode the alternative line comes before its sentence.
    ``tag_edits`` wraps alternatives in ``<edit>…</edit>`` (input of tag parsing).
    """
    def sent_lines(s):
        if not edited:
            return F.array(s["sentence"])
        alt = s["alternative"]
        if tag_edits:
            alt = F.concat(F.lit("<edit>"), alt, F.lit("</edit>"))
        return F.when(s["alternative"].isNotNull(), F.array(alt, s["sentence"])).otherwise(F.array(s["sentence"]))

    def sub_lines(st):
        head = F.array(F.lit(""), F.concat(F.lit("=="), st["sub_title"], F.lit("==")))
        return F.concat(head, F.flatten(F.transform(st["sentences"], sent_lines)))

    lines = F.concat(F.array(F.col("article.title")), F.flatten(F.transform("article.sub_titles", sub_lines)))
    return articles.select(*doc_keys, F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def select_article(articles: DataFrame, index: int, index_col: str = "article_index") -> DataFrame:
    """Pick one article by position; out of range -> error (as the renderer's CLI)."""
    one = articles.filter(F.col(index_col) == index)
    if index < 0 or one.limit(1).count() == 0:
        raise ValueError("Index out of bounds")
    return one
