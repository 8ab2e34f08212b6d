"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Each query runs once to warm up and then three times into a
no-op sink, so every column is computed; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from docspark.plans import PLANS  # noqa: E402
from docspark.session import build_session  # noqa: E402

HEADLINE = [
    "a01_global_kpis", "a17_coverage_by_aircraft", "a25_ocr_summary_wide",
    "a33_import_summary", "j01_document_facts", "j05_resolve_aircraft",
    "j06_resolve_linked_wp", "j10_exact_duplicates", "l01_paginate_wide",
    "w03_segment_pages", "w05_copies_to_delete", "w09_running_statistics",
    "x08_extract_entities", "m06_classify_cascade", "m13_classification_metrics",
    "m21_document_ocr_rollup", "r03_substring_search", "r05_hybrid_search",
    "r08_token_search", "c09_linked_wp_repair",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        f"local[{cpus}]", cpus, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for attempt in range(4):
            start = time.perf_counter()
            frame = PLANS[name].run(spark, folder)
            frame.write.format("noop").mode("overwrite").save()
            if attempt:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
