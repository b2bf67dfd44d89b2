"""Time the headline queries; prints one JSON line.

Every query runs twice in one session and the second run counts, so that the times are
those of a running cluster and not of JVM and worker start-up. Both times are printed.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
BENCH_QUERIES may name other registered queries, separated by commas.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioquery.catalog import all_queries  # noqa: E402
from folioquery.session import build_session  # noqa: E402

HEADLINE = [
    "chunk_documents",
    "hash_embed_chunks",
    "summarize_extractive",
    "concat_chunks",
    "topk_exact",
    "topk_exact_blocks",
    "topk_per_request_k",
    "topk_ivf",
    "ivf_recall",
    "similarity_join",
    "retrieve_filtered",
    "retrieve",
    "answer_extractive",
    "answer_questions",
    "corpus_roundtrip",
    "embed_once",
    "validate_requests",
    "query_cache_key",
    "cache_lookup",
    "upsert_summaries",
    "cascade_delete",
    "ttl_reuse",
    "retry_tasks",
    "stream_chunks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "folioquery-bench",
        master=f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        all_queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    first, timings = {}, {}
    for name in names:
        first[name] = timed(name)
        timings[name] = timed(name)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "first_run": first,
                "sf": Path(folder).name,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
