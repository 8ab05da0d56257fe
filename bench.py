"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foliant.plans import QUERIES  # noqa: E402
from foliant.session import local_session  # noqa: E402

HEADLINES = (
    "corpus_stats", "search_pages", "strike_levels", "inactivity_sessions", "dialogue_graph",
    "chunk_reconcile", "clean_pages", "html_to_markdown", "recursive_chunks", "dialogue_chunks",
    "merge_up_chunks", "vocabulary", "cosine_topk", "question_topk", "lexical_topk", "hybrid_topk",
    "batch_retrieval", "archive_excuse", "classify_messages", "reachable_pages",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus}))


if __name__ == "__main__":
    main()
