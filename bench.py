"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The shared tables are single files of one row group, which Spark reads in one task. They are
first copied into as many files as cores, as tables of any size come; the copy is not timed.
Each query runs once to warm up code generation and once for the clock. The result is
written to the ``noop`` sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plenum import build_session  # noqa: E402
from plenum.catalog.registry import entries  # noqa: E402

HEADLINES = [
    "block_topk_direct", "block_topk_by_label", "runoff_range_topk", "district_topk_city_boost", "race_matching",
    "clean_candidate_fields", "expand_elections", "temporal_match", "clean_documents", "cleaning_verdicts", "exact_duplicates",
    "near_duplicates", "filter_messages", "split_messages", "classify_messages", "validate_messages", "issue_insights", "compound_patterns",
    "poll_completion", "theme_rollup", "silhouette", "within_cluster_distance", "density_clusters", "density_tree", "choose_k", "pii_scan", "sanitize_html",
    "verify_quotes", "table_profile", "usage_by_model", "campaign_json", "message_insights",
]


def clock(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def in_files(spark, folder: str, files: int) -> str:
    """A copy of all tables in ``files`` files each."""
    target = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{folder}/{name}").repartition(files).write.parquet(f"{target}/{name}")
    return target


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog, times, label = entries(), {}, os.path.basename(folder.rstrip("/")).removeprefix("sf")
    folder = in_files(spark, folder, int(cpus))
    for name in HEADLINES:
        run = lambda name=name: catalog[name][0](spark, folder)
        clock(run)
        times[name] = round(clock(run), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": label,
    }))


if __name__ == "__main__":
    main()
