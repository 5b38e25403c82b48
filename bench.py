"""Times the headline queries: prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose the data and the cores.
Every query is run in full (a no-op sink takes all its rows) once to warm up and once for the clock.
"""

from __future__ import annotations

import json
import os
import sys
import time

from relops.session import get_spark
from relops.workload import QUERIES

HEADLINE = [
    "upsert_orders",
    "upsert_composite_key",
    "upsert_null_and_repeated_keys",
    "delete_by_key",
    "delete_multi_key",
    "merge_changefiles_events",
    "merge_changefiles_hot_key",
    "table_diff_duplicate_keys",
    "transfer_diff_documents",
    "latest_run_as_of_events",
    "schema_as_of",
    "latest_release",
    "transfer_rollup",
    "section_counts",
    "export_parts",
    "scan_csv",
    "scan_jsonl",
    "save_partitioned",
    "save_clustered",
    "apply_changefile_release",
    "normalise_datetime",
    "crc32c_base64",
    "chunk_list",
    "replace_text",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begun, 3)

    for name in names:
        run(name)
    timings = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "release_maintenance_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
