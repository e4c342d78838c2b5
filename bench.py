"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and once to be timed; its rows are written to the noop sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from corpusloom.plans import roster
from corpusloom.session import local_session

HEADLINE = ("dense_topk", "dense_filtered", "freshness_rank", "batch_topk", "bm25_plain", "bm25_boolean", "hybrid_rrf", "hybrid_provenance", "chunk_words", "chunk_sentences", "multiscale_words", "merge_first_wins", "cache_misses", "manifest", "pack_batches", "spread_scores", "index_round_trip")


def timed(spark, run, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", **{"spark.sql.shuffle.partitions": os.environ.get("BENCH_CPUS", "8")})
    seconds = {}
    for name in HEADLINE:
        try:
            timed(spark, roster.QUERIES[name], sf_dir)
            seconds[name] = round(timed(spark, roster.QUERIES[name], sf_dir), 3)
        except Exception as error:  # noqa: BLE001 - one failure must not hide the other figures
            print(f"{name}: {error}", file=sys.stderr)
    print(json.dumps({"metric": "headline queries, one warm run each", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
