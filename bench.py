"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR   folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query after one warm-up; the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagelode.plans import views  # noqa: E402
from pagelode.plans.catalog import QUERIES  # noqa: E402
from pagelode.plans.index import write_index  # noqa: E402
from pagelode.session import local_session, scratch_path  # noqa: E402

HEADLINE = (
    "parse_pages raw_links tokenize match_multifield match_phrase match_prefix "
    "bm25_score search suggest rank_results crawl_frontier document_compact stream_ingest"
).split()


def index_build(spark, folder):
    docs = views.text_documents(spark, folder)
    return write_index(docs, scratch_path(spark, "bench-index"), views.PLAIN).field_stats


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    seconds = {}
    for name, run in {"index_build": index_build, **{n: QUERIES[n] for n in HEADLINE}}.items():
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {[round(t, 2) for t in times]}", file=sys.stderr, flush=True)

    pages = views.table(spark, folder, "pages").count()
    queries = views.table(spark, folder, "benchmark").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
                "pages_per_sec": round(pages / seconds["parse_pages"], 1),
                "searches_per_sec": round(queries / seconds["search"], 1),
                "ingest_pages_per_sec": round(pages / seconds["stream_ingest"], 1),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
