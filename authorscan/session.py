"""Session helpers: building a session for tests/bench, reading the driver tables,
and the checkpoint folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "authorscan", extra: dict | None = None) -> SparkSession:
    b = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tables_version(spark: SparkSession, sf_dir: str) -> tuple:
    """When each table's file or folder was last changed (None: not there)."""
    conf, out = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in TABLES:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = p.getFileSystem(conf)
        out.append(fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None)
    return tuple(out)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is always read from the
    session. Only a local master, as in tests, gets a private folder where it is
    unset; executors of a cluster would not see one another's, so there it raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="authorscan-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_STAGES: list[tuple[str, str | None]] = []


def note_stage(path: str, table: str | None = None) -> None:
    """Remember a stage table (a folder, and its name in the catalog if it has one) for ``recorded_stages``."""
    _STAGES.append((path, table))


@contextmanager
def recorded_stages() -> Iterator[list[tuple[str, str | None]]]:
    """The list fills, when the block ends, with the stage tables written inside it and not removed yet."""
    before, written = set(_STAGES), []
    try:
        yield written
    finally:
        written += [s for s in _STAGES if s not in before]


def remove_stages(spark: SparkSession, stages: list[tuple[str, str | None]]) -> None:
    """Delete stage tables that nothing will read again."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path, table in stages:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    gone = set(stages)
    _STAGES[:] = [s for s in _STAGES if s not in gone]


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of the queries run inside the block when each has ended (else they stay until
    the driver happens to collect its garbage). Meant for writes: their plans are made anew and never read again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")  # with None for a default it reads None even where Spark has the setting
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame, bucket: str | None = None, n: int = 0) -> DataFrame:
    """Write ``df`` as a Parquet table under ``spark.checkpoint.dir`` and read it back.

    One job; later plans start from the stored table (short lineage, survives
    executor loss) and the planner sees its real size, so AQE can pick
    broadcast joins for small stage outputs. With ``bucket`` the rows lie in ``n`` hash buckets of that column:
    windows, groups and cogroups that include it read them without a shuffle. Meant for rows whose tasks hold few of its values.
    """
    spark = df.sparkSession
    root = checkpoint_dir(spark).rstrip("/")
    name = f"stage_{uuid.uuid4().hex}"
    path = f"{root}/{name.replace('_', '-')}"
    if bucket:  # made empty and then filled: Spark leaves the shuffles of a query that makes its table
        (df.limit(0).write.mode("error").format("parquet").option("compression", "zstd").option("path", path)
         .bucketBy(n, bucket).saveAsTable(name))
    with shuffles_removed(spark):
        if bucket:
            df.write.insertInto(name)
        else:
            df.write.mode("error").option("compression", "zstd").parquet(path)
    note_stage(path, name if bucket else None)
    return spark.table(name) if bucket else spark.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition ``df`` by ``keys`` when its scan yields fewer partitions
    than the cluster can run at once (e.g. a small file written as one row
    group). Large inputs already split into many tasks are left untouched."""
    spark = df.sparkSession
    par = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= par:
        return df
    return df.repartition(max(2 * par, shuffle_partitions(spark)), *keys)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
