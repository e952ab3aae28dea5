"""Driver contract: entry() runs; selected queries equal their DuckDB twins (sf0.001)."""

import duckdb
import pytest

from authorscan.session import TABLES
from tests.conftest import SF001

import __spark_entry__ as E  # noqa: E402


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"doc_id", "HC", "hc_threshold", "n_valid"} <= set(df.columns)


def test_every_query_has_types_and_sql_is_for_registered_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["edit_budget", "ngram_logloss", "doc_hc", "grid_pvalue", "roc", "threshold_acc"])
def test_oracle_equal(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    s = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    d = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
    assert s == d


def test_changed_tables_give_new_answers(spark, tmp_path):
    import os

    def write(n):
        rows = [(c, t, role, f"{role} {c} {t}") for c in range(n) for t, role in ((0, "user"), (1, "assistant"))]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")

    write(3)
    assert E.queries()["pair_long"](spark, str(tmp_path)).count() == 6
    write(5)
    os.utime(tmp_path / "conversations.parquet", (2e9, 2e9))
    assert E.queries()["pair_long"](spark, str(tmp_path)).count() == 10
