"""Time the registered queries on the driver tables and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Every query runs once to warm up the JVM and once timed; the result is written to the
no-op sink, so all rows are computed and none reach the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "bucket_programs", "selectivity_rank", "eval_rows", "gap_rows", "eval_applications", "boundary_compare",
    "sieve_year_stats", "opportunities", "keep_best", "ordered_unique", "compose_history", "overlay_years",
    "gap_clusters", "coalesce_intervals", "band_join", "contains_join", "domain_join", "page_text",
    "page_links_scored", "text_rules", "major_lists", "token_lists", "keyword_hits", "label_sync_full",
    "unresolved_report", "multi_mode_sort", "record_rows", "coerce_rows",
]


def main() -> None:
    from cutline import plans
    from cutline.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "cutline-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__cutline__textPartitions=cpus,  # the texts are one row group at these sizes
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
        spark__sql__dataFrameQueryContext__enabled="false",
    )
    plans.load()
    wanted = sys.argv[1:] or HEADLINE
    if wanted == ["all"]:
        wanted = list(plans.QUERIES)
    times: dict[str, float] = {}
    for name in wanted:
        for attempt in range(2):
            start = time.perf_counter()
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
