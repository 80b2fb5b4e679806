"""Headline timings. Prints one JSON line; one warm-up, then the median of BENCH_REPEATS (2) runs per query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docquarry.catalog import QUERIES  # noqa: E402
from docquarry.session import build_session  # noqa: E402

HEADLINE = (
    "bm25_topk bm25_stored_index bm25_multi_query_merge fuzzy_terms term_stats chunk_fixed chunk_recursive full_scan "
    "ingest_documents hash_embed knn_cosine knn_documents ivf_search rerank_topn hybrid_rrf retrieve context_assembly "
    "upsert_latest delete_by_ids star_enrich classify_requests collapse_runs ctc_decode box_text page_blocks stream_ingest"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names if names != ["all"] else QUERIES:
        taken = []
        for attempt in range(repeats + 1):
            start = time.perf_counter()
            # The noop sink computes every column of every row; a count would let Spark skip them.
            result = QUERIES[name](spark, folder)
            result.write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        rows[name] = result.count()
        print(f"{name} {taken} rows {rows[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows": rows, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
