"""Runs and what they leave (S11 S12 S13 S14 S15): stage outputs and reports under a run id, with a manifest.

Layout: ``root/table/run=<id>/<keys>/`` for every table and ``root/manifest/run=<id>/`` for one row a table (rows, parameters).
A run replaces what an earlier run of the same id wrote; other runs stay. Stage tables that its plans stored on the way
(``session.cut_lineage``) are removed when it ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from authorscan.params import Params
from authorscan.session import recorded_stages, remove_stages
from authorscan.sources.cache import path_exists

# Partition keys of the tables that a detection run leaves; others are written without.
TABLE_KEYS = {"doc_scores": ("topic", "edit_ratio", "fold"), "hc_null": ("variant", "gamma")}


class Run:
    def __init__(self, store: RunStore, run_id: str, params: Params | None):
        self.store, self.run_id, self.params, self.rows = store, run_id, params, {}

    def write(self, table: str, df: DataFrame, keys: tuple | None = None) -> DataFrame:
        """Write ``df`` as the run's ``table`` and read it back (a stage boundary: later stages start from it)."""
        if table == "manifest":
            raise ValueError("the manifest is written by the run itself")
        keys = TABLE_KEYS.get(table, ()) if keys is None else keys
        seen = Observation()
        (df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(*keys)
         .parquet(f"{self.store.root}/{table}/run={self.run_id}"))
        self.rows[table] = seen.get["n"]
        return self.store.read(table, self.run_id)


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @contextmanager
    def run(self, run_id: str, params: Params | None = None) -> Iterator[Run]:
        """A run: its manifest is written if the block ends well; its stage tables are removed in any case."""
        run = Run(self, run_id, params)
        written: list = []
        try:
            with recorded_stages() as written:
                yield run
            self._manifest(run)
        finally:
            remove_stages(self.spark, written)

    def _manifest(self, run: Run) -> None:
        config = json.dumps(asdict(run.params), sort_keys=True) if run.params else None
        rows = [(table, n, config) for table, n in sorted(run.rows.items())]
        (self.spark.createDataFrame(rows, "table string, rows long, params string").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/manifest/run={run.run_id}"))

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """``table`` of one run, or of all runs that have it (column ``run``); filters on its keys prune partitions."""
        path = f"{self.root}/{table}" + (f"/run={run_id}" if run_id else "")
        if not path_exists(self.spark, path):
            raise FileNotFoundError(f"no run has left {table} under {self.root}" + (f" as {run_id}" if run_id else ""))
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(path)

    def runs(self) -> DataFrame:
        """``run, table, rows, params`` of every finished run."""
        return self.read("manifest").select("run", "table", "rows", "params")
