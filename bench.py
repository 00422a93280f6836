"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores.
Each query runs once untimed on the smallest tables, so that the time holds the
work and not the loading of classes, and is then computed in full.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpusdesk.plans.catalog import QUERIES  # noqa: E402
from corpusdesk.plans.q_search import corpus  # noqa: E402
from corpusdesk.session import local_session  # noqa: E402

HEADLINE = (
    "vector_topk", "lexical_topk", "search", "build_context", "recall_at_k", "chunk_words", "chunk_articles",
    "dedupe_documents", "mask_pii", "sanitize_draft", "build_postings", "history_arrays", "latest_per_key",
    "chapter_asof", "audit_transitions", "sessions_idle_batch", "retention_purge", "intent_counts_stream",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    warm = str(Path(sf_dir).parent / "sf0.001")
    times = {}
    # the index that searches read is written once and timed on its own
    for folder in (warm, sf_dir):
        if os.path.isdir(folder):
            start = time.perf_counter()
            corpus(spark, folder)
            times["write_index"] = round(time.perf_counter() - start, 3)
    for name in names:
        if os.path.isdir(warm):
            run(QUERIES[name](spark, warm))
        start = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
