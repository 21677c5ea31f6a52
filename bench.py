"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from captrail.plans import load_all, registry
from captrail.session import local_session

HEADLINE = (
    "timeline_quality", "resolve_overlaps", "filter_dominant", "cue_at", "cues_in_window", "snap_to_frames",
    "text_forms", "rank_candidates", "sessionize", "build_events", "stable_intervals", "refine_boundaries",
    "fuse_asr", "timeline_report", "align_timelines", "parent_state", "edit_state", "progress_state", "latest_snapshot",
    "greedy_match", "evaluate_timelines", "similar_texts", "estimate_roi",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "captrail-bench")
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
