"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; a row's fractional rank is
(rank + 1/2) / (rows of its source). All rows sorted by it interleave the sources in proportion, and the order is
cut into ``shards`` runs whose counts differ by one at most, so every shard has the mixture of the whole table. Both rankings
are places in a sort over range partitions, so a source with a third of all rows is cut over many tasks: a row's place is its
place in its partition and the rows of the partitions before it, of which there is one number a partition.

Defined cases: a null source is a stratum of its own; null text counts as empty; ties in the hash are
ordered by doc_id, then checksum and size, and rows equal in all of these are interchangeable; equal
texts have no say in where a row goes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorscan.llm.blocks import store
from authorscan.session import shuffle_partitions


def place(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``, the place from 0 in the sort by ``order``; written once, so that places stay."""
    n = shuffle_partitions(rows.sparkSession)
    number = F.monotonically_increasing_id()  # partition << 33 | place in it
    cut = store(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", number))
    part = F.shiftright("__id", 33)
    sizes = cut.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    begin, at = [], 0
    for r in sorted(sizes.collect()):  # one row a partition
        begin.append((r["__part"], at))
        at += r["__n"]
    before = F.broadcast(rows.sparkSession.createDataFrame(begin, "__part long, __before long"))
    return (cut.withColumn("__part", part).join(before, "__part")
            .withColumn(out, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__before"))


def interleave(rows: DataFrame, stratum: str, order: list[str], shards: int) -> DataFrame:
    """``rows`` with shard, slot (gapless from 0 in each shard) and fractional_rank; ``order`` shuffles a stratum."""
    ranked = store(place(rows, [stratum, *order], "__rank"))
    sizes = store(ranked.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"), F.min("__rank").alias("__first")))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    sizes = sizes.withColumnRenamed(stratum, "__stratum")
    ranked = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("__stratum")))
    ranked = ranked.withColumn("fractional_rank", (2 * (F.col("__rank") - F.col("__first")) + 1) / (2 * F.col("__n")))
    placed = place(ranked.drop("__rank", "__first", "__n", "__stratum"), ["fractional_rank", stratum, *order], "__at")
    shard = F.expr(f"__at * {shards} div {max(total, 1)}")
    begin = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("__at") - begin).cast("long")).drop("__at")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), source, fractional_rank for each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = store(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("h")))
    out = interleave(rows, "source", ["h", "doc_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source", "fractional_rank")
