"""Headline timings: prints one JSON line.

Every query starts from a fresh dataset and an empty cache, so each pays for
its own scans. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.inputs import dataset, predictions, table  # noqa: E402
from columnary.operators import charts, drift, metrics, profile, quality, slices, stats, supervised, tally, targets, unsupervised  # noqa: E402
from columnary.operators.supervised import prepare  # noqa: E402
from columnary.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def logistic(spark, ds) -> None:
    """Prepare, split and fit the linear model of the benchmark, all rows."""
    p = prepare(ds, "l_returnflag")
    model = supervised.class_models(p.train_rows, len(p.labels), 1, 1, 1)[0][1].setMaxIter(50).fit(p.train)
    sink(metrics.classification_metrics(supervised.scored(p, model)))
    p.release()


def forest(spark, ds) -> None:
    """Prepare, split and fit the random forest of the benchmark, all rows."""
    p = prepare(ds, "o_orderstatus")
    model = supervised.class_models(p.train_rows, len(p.labels), 20, 1, 8)[1][1].fit(p.train)
    sink(metrics.classification_metrics(supervised.scored(p, model)))
    p.release()


QUERIES = {
    "column_facts": lambda s: sink(tally.column_facts(dataset(s, SF_DIR, "lineitem", True))),
    "duplicate_rows": lambda s: sink(quality.duplicate_rows(dataset(s, SF_DIR, "lineitem", True))),
    "column_profile": lambda s: sink(profile.column_profile(dataset(s, SF_DIR, "lineitem", True))),
    "profile_documents": lambda s: sink(profile.column_profile(dataset(s, SF_DIR, "documents", True))),
    "quality_score": lambda s: sink(quality.quality_score(dataset(s, SF_DIR, "dirty", True))),
    "numeric_summary": lambda s: sink(stats.numeric_summary(dataset(s, SF_DIR, "lineitem", True))),
    "categorical_summary": lambda s: sink(stats.categorical_summary(dataset(s, SF_DIR, "orders", True))),
    "correlation_matrix": lambda s: sink(stats.correlation_matrix(dataset(s, SF_DIR, "lineitem", True))),
    "histograms": lambda s: sink(charts.histograms(dataset(s, SF_DIR, "lineitem", True))),
    "drift_checks": lambda s: sink(drift.drift_checks(dataset(s, SF_DIR, "events", True))),
    "target_scores": lambda s: sink(targets.heuristic_targets(dataset(s, SF_DIR, "lineitem", True))),
    "roc_auc": lambda s: sink(metrics.roc_auc(predictions(s, SF_DIR))),
    "target_slices": lambda s: sink(slices.target_slices(dataset(s, SF_DIR, "lineitem", True), "l_returnflag", "classification", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"])),
    "profile_wide": lambda s: sink(profile.column_profile(dataset(s, SF_DIR, "wide", True))),
    "correlation_wide": lambda s: sink(stats.correlation_matrix(dataset(s, SF_DIR, "wide", True))),
    "forest_fit": lambda s: forest(s, dataset(s, SF_DIR, "orders", True)),
    "logistic_fit": lambda s: logistic(s, dataset(s, SF_DIR, "lineitem", True)),
    "unsupervised_scan": lambda s: sink(unsupervised.unsupervised_scan(dataset(s, SF_DIR, "orders", True)).rows),
}


def main() -> None:
    spark = build_session("columnary-bench", f"local[{CPUS}]", int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    sink(table(spark, SF_DIR, "lineitem"))  # warm the JVM and the file cache
    wanted = sys.argv[1:] or list(QUERIES)
    times, errors = {}, {}
    for name in wanted:
        spark.catalog.clearCache()
        start = time.perf_counter()
        try:
            QUERIES[name](spark)
        except Exception as failed:  # the other times count all the same
            errors[name] = f"{type(failed).__name__}: {str(failed)[:200]}"
            continue
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}
    print(json.dumps(line | ({"errors": errors} if errors else {})))


if __name__ == "__main__":
    main()
