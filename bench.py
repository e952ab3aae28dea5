"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs from a cold query cache (its stage tables are rebuilt), is
executed in full with the ``noop`` sink (no driver collection), and timed.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sentence_atoms",     # split + word count + numbering (T3 T1 F1 W1)
    "edit_budget",        # articles -> atoms with edit budget (F1 F2 W2 U4)
    "ngram_logloss",      # bigram LM fit + scoring of every atom (M1 M3)
    "null_grid",          # per (topic, fold, length) survival grid (A3 A4)
    "doc_hc",             # full detection: p-values + HC per document (M4)
    "exact_pvalue",       # as-of p-values (J3)
    "calibrate",          # ROC / AUC / Youden / threshold sweeps (A18-A23)
    "cv_summary",         # full k-fold accuracy experiment, 3 edit ratios (M9 A26)
    "power_summary",      # full power experiment, 2 edit ratios x 3 sizes (M10 A27)
    "lor_cv",             # embedding classifier, 15 keys x 10 folds (M8 A28)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from authorscan.plans import catalog
    from authorscan.session import build_session, checkpoint_dir

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                          extra={"spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)})
    checkpoint_dir(spark)
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    times = {}
    for name in names:
        catalog._CORPORA.clear()
        t0 = time.time()
        df = catalog.REGISTRY[name].spark(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
