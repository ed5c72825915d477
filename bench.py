"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from talkloom.plans.registry import registered  # noqa: E402
from talkloom.session import build_session  # noqa: E402

HEADLINE = [
    "speaker_profiles", "unit_boundaries", "transcript_units", "segments_proposed", "frame_plan", "near_duplicate_frames", "palette_candidates",
    "timeline_events", "speaker_turns", "scene_context_windows", "marker_hits", "label_quarantine", "plan_validation_errors", "qa_merge", "chunks",
    "claim_validation_errors", "claim_cleanup", "claims_dedup_merge", "curation_apply", "request_cache_split", "effective_claims", "surface_drift",
    "event_counters", "stage_freshness", "drift_union", "top_topics", "redact_text", "stream_event_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.talkloom.spread": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
