"""Headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "chunk_documents",
    "chunk_sources",
    "embedding_tokens",
    "hash_embedding",
    "cosine_topk_scoped",
    "retrieve_boosted",
    "section_keywords",
    "best_sentence",
    "heading_sections",
    "outline_nodes",
    "node_evidence",
    "map_summary",
    "extractive_answer",
    "answer_questions",
    "reap_stale",
)


def main() -> None:
    from cartulary.plans import load_queries
    from cartulary.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    registered = load_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in chosen:
        started = time.perf_counter()
        registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
