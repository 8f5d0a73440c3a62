"""Time the headline queries; prints one JSON line.

Folder from BENCH_SF_DIR, cores from BENCH_CPUS. Every query runs in full into a sink
that discards rows, so that no time goes into moving results to the driver. The figures are
medians of up to three passes over all queries; no pass begins after PATIENCE seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from argentum.session import get_session  # noqa: E402
from driver_queries import QUERIES  # noqa: E402

PASSES, PATIENCE = 3, 300

HEADLINES = [
    "cohort_new_cases",
    "documents_of_persons",
    "biopsy_reports",
    "earliest_procedure_per_visit",
    "known_dates",
    "mentions_offsets",
    "mentions_once_per_note",
    "asof_exact",
    "asof_backward",
    "asof_nearest",
    "match_dates_within_days",
    "align_proximity",
    "align_uniform",
    "split_test",
    "split_three_way",
    "gold_merge",
    "export_balanced",
    "dense_row_ids",
    "percentile_bounds",
    "moving_loss",
    "loss_profile_curves",
    "lrt_flip",
    "loss_nce_rce",
    "metrics_by_status",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINES
    run("value_counts")  # starts the executor threads and compiles the first classes
    passes: dict[str, list[float]] = {name: [] for name in names}
    began = time.perf_counter()
    for k in range(PASSES):
        if k and time.perf_counter() - began > PATIENCE:
            break
        for name in names:
            start = time.perf_counter()
            run(name)
            passes[name].append(time.perf_counter() - start)
    times = {name: round(median(spent), 3) for name, spent in passes.items()}
    sf = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
