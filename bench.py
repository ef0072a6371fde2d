"""Time the headline queries.

Reads `$BENCH_SF_DIR` (default sf0.1), runs on `local[$BENCH_CPUS]` and prints
one JSON line.  Each query runs once to warm up and then `$BENCH_RUNS` times;
the median is reported.  Results are fully computed and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from lectern.plans import load_all
from lectern.session import build_session

HEADLINE = (
    # corpus
    "corpus_to_chunks", "line_rules", "sentence_split", "greedy_pack", "prose_chunks", "play_chunks", "play_parse",
    "paragraph_repair", "rule_dry_run", "markup_blocks", "quote_markup", "loop_collapse",
    # catalogue, library and timelines
    "history_page", "history_statistics", "story_detail_join", "versions_in_order", "promote_after_delete",
    "sequential_start_times", "active_items_at_time", "batch_move", "version_natural_order", "renumber_after_split",
    "voice_precedence", "log_ring_buffer",
    # quality control, state and signals
    "duration_matched_score", "anomaly_queue", "take_selection_slots", "speed_average", "runaway_labels",
    "throttled_progress", "overlap_mix", "lost_words",
)


def run(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", shuffle=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all().QUERIES
    times = {}
    for name in wanted:
        run(spark, queries[name], sf_dir)
        times[name] = round(statistics.median(run(spark, queries[name], sf_dir) for _ in range(runs)), 4)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
