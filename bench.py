"""Headline queries on the given tables; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default scale 0.1) and ``BENCH_CPUS`` the local cores. Each query is
written to the no-op sink, so all its rows are computed. One short query runs first to start the workers.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brewlens import Workspace, build_session  # noqa: E402
from brewlens import bindings as B  # noqa: E402
from brewlens import workload  # noqa: E402

QUERIES = [
    "time_range", "group_by_strain", "batch_search", "topk_batches", "batch_summary", "phase_join_stats",
    "batch_metrics", "growth_rate_by_strain", "asof_unified", "align_long", "align_grid", "golden_profile", "zscore",
    "smooth", "pelt_phases", "online_phases", "dtw_scores", "linear_sensor", "melt_units", "historian_pull",
    "chain_verify", "merkle_root", "inclusion_proofs", "lineage_down", "compliance_report",
]


def csv_import(spark, sf_dir: str) -> float:
    """Import all events as one delimited file per variable, including the stored tables."""
    folder = tempfile.mkdtemp(prefix="brewlens-bench-")
    try:
        rows = B.events(spark, sf_dir).selectExpr(
            "event_type", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS timestamp", "value AS OD600")
        rows.repartition(5, "event_type").write.partitionBy("event_type").option("header", True).csv(f"{folder}/in")
        start = time.perf_counter()
        Workspace(spark, f"{folder}/store", buckets=8).import_files(f"{folder}/in")
        return time.perf_counter() - start
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "brewlens-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    runs = workload.queries()
    runs["model_sensor"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in QUERIES:
        start = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    times["csv_import"] = round(csv_import(spark, sf_dir), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cores": int(cpus),
        "shuffle_partitions": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
