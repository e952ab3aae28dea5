"""Score caches (S6) and the score store: normalised text -> response.

The published form of a cache is one JSON object ``{text: logloss, ...}``, one row however large; JSON lines
``{"text": ..., "response": ...}`` are split among tasks. A :class:`ScoreStore` is a cache that grows: a run scores
the texts it lacks and adds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authorscan.functions.text import cache_key
from authorscan.session import cut_lineage, recorded_stages, remove_stages, shuffles_removed

CACHE_SCHEMA = T.StructType([T.StructField("sent_key", T.StringType()), T.StructField("response", T.DoubleType())])


def _id(key) -> Column:
    return F.unhex(F.md5(key)).alias("_id")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_score_cache(spark: SparkSession, path: str | None, fmt: str = "json", allow_missing: bool = False,
                     unique: bool = True) -> DataFrame:
    """``sent_key, response`` of a cache file (``json``, ``jsonl`` or ``parquet``).

    No path is no cache. A path that does not exist is an error, or with ``allow_missing`` an empty cache. A key must
    map to one response (``unique`` checks it)."""
    if not path:
        return spark.createDataFrame([], CACHE_SCHEMA)
    if not path_exists(spark, path):
        if allow_missing:
            return spark.createDataFrame([], CACHE_SCHEMA)
        raise FileNotFoundError(f"score cache {path} does not exist")
    if fmt == "parquet":
        df = spark.read.parquet(path).select("sent_key", F.col("response").cast("double"))
    elif fmt == "jsonl":
        df = spark.read.schema("text string, response double").json(path).select(cache_key("text").alias("sent_key"), "response")
    else:
        raw = spark.read.option("wholetext", True).text(path)
        m = F.from_json("value", T.MapType(T.StringType(), T.DoubleType()))
        df = raw.select(F.explode(m).alias("k", "response")).select(
            cache_key(F.col("k")).alias("sent_key"), "response")
    return assert_unique_keys(df) if unique else df


def assert_unique_keys(cache: DataFrame) -> DataFrame:
    """Normalised keys with two different responses are rejected."""
    two = cache.groupBy("sent_key").agg(F.min("response").alias("a"), F.max("response").alias("b")).filter("a <> b")
    if not two.isEmpty():
        raise ValueError("score cache has duplicate keys after normalisation")
    return cache


def write_score_cache(df: DataFrame, path: str, text_col: str = "text", response_col: str = "response") -> None:
    (df.select(cache_key(text_col).alias("sent_key"), F.col(response_col).alias("response"))
     .filter(F.col("response").isNotNull()).dropDuplicates(["sent_key"])
     .write.mode("overwrite").parquet(path))


class ScoreStore:
    """Responses by normalised text, kept between runs: Parquet partitioned by key hash and by the run that added them.

    Adding is a dynamic overwrite of the partitions (bucket, run), so a run that is repeated replaces what it had
    written and leaves the rest. Texts that have no response are kept too (NULL), so they aren't scored again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def read(self) -> DataFrame:
        """``sent_key, response``, one row a key (the least response, should two runs have scored a key at the same time)."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        return self._rows().groupBy("sent_key").agg(F.min("response").alias("response"))

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("sent_key string, response double, bucket int, run string").parquet(self.path)

    def _known(self) -> DataFrame:
        """``_id, response`` of :meth:`read`: the keys' hashes stand for them, so no text is dealt."""
        rows = self._rows() if path_exists(self.spark, self.path) else self.spark.createDataFrame([], CACHE_SCHEMA)
        return rows.select(_id("sent_key"), "response").groupBy("_id").agg(F.min("response").alias("response"))

    def add(self, scores: DataFrame, run: str) -> None:
        rows = scores.select("sent_key", "response", F.pmod(F.xxhash64("sent_key"), F.lit(self.buckets)).cast("int").alias("bucket"))
        rows = rows.repartition("bucket").groupBy("bucket", "sent_key").agg(F.min("response").alias("response"))  # keys are dealt once
        with shuffles_removed(self.spark):
            (rows.select("sent_key", "response", "bucket", F.lit(run).alias("run")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket", "run").parquet(self.path))

    def score(self, df: DataFrame, scorer, run: str, text_col: str = "text", out: str = "response", carry: tuple = ()) -> DataFrame:
        """J1 with a store that grows: ``df`` with its responses; what the store lacks is scored by ``scorer`` and added.

        ``scorer`` (DataFrame with ``text_col`` and ``carry`` -> the same with ``out``) sees one text for each missing key (the
        least, with its ``carry`` columns); with none missing it isn't called.
        """
        keyed = df.withColumn("_id", _id(cache_key(text_col)))
        with recorded_stages() as passing:
            missing = cut_lineage(keyed.filter(F.col("_id").isNotNull()).join(self._known().select("_id"), "_id", "left_anti")
                                  .groupBy("_id").agg(F.min(F.struct(text_col, *carry)).alias("s")).select("s.*"))
        if not missing.isEmpty():
            self.add(scorer(missing.withColumn("sent_key", cache_key(text_col))).select("sent_key", F.col(out).cast("double").alias("response")), run)
        remove_stages(self.spark, passing)
        known = self._known().withColumnRenamed("response", out)
        return keyed.join(known, "_id", "left").drop("_id")
