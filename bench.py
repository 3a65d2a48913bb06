"""Benchmark the headline queries.

Runs each query fully (``write.format('noop')`` executes the whole plan
without collecting anything to the driver) on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "tag_scoreboard_pivot",
    "tag_scoreboard",
    "exact_mood_first_tag",
    "match_coverage",
    "label_documents",
    "index_documents",
    "tokens_treebank",
    "vocabulary",
    "encode_tokens",
    "skipgram_pairs",
    "tfidf",
    "language_id",
    "split_80_10_10",
    "balance_classes",
    "build_dataset",
    "nearest_k",
    "embedding_lookup",
    "confusion_long",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    from cadenza.registry import QUERIES
    from cadenza.session import build_session

    spark = build_session(master=f"local[{cpus}]", app="cadenza-bench", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "24g")})
    # warm up the JVM and the parquet reader on a small query
    QUERIES["table_profile"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
