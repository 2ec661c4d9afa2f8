"""Times the headline queries, each the median of its runs; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (prefixes),
BENCH_RUNS (default 3).
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f1_frames_with_logos", "s3_assign_frame_ids", "s6_pair_with_previous", "g1_grid_patches", "a1_collect_complete",
    "a2_collect_complete_distinct", "a3_collect_complete_multi", "g4_expand_samples", "j1_join_frames_detections",
    "j2_join_patch_frame", "w3_hold_detections", "u2_dedupe_updates", "k2_rank_templates", "k3_cap_bank", "j12_priority_update",
    "m7_update_bank", "p5_patch_key", "p8_quad_valid", "p9_project_corners", "j3_knn_match", "m2_match_patches",
    "m3_fit_homography", "k4_tightest_box", "m4_verify_matches", "a6_response_threshold", "j5_suppress_occupied", "t2_seed_points",
    "j6_advance_points", "j7_advance_points_median", "t5_track", "a7_trace_stats", "t6_valid_traces", "p17_trace_overlay",
    "j8_trace_frame_window", "j9_frames_in_trajectory", "p2_to_gray", "t1_corner_response", "d2_hog", "d3_mbh", "d5_block_descriptor",
    "d6_trace_features", "r1_l2_slice", "r2_pca_project", "r3_gmm_posteriors", "r4_fisher_encode", "r9_recognise_windows",
]


def main() -> None:
    from vidspark.registry import QUERIES
    from vidspark.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), max(1, int(os.environ.get("BENCH_RUNS", "3")))
    only = os.environ.get("BENCH_QUERIES", "").split()
    spark = build_session(
        f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if only and not any(name.startswith(o) for o in only):
            continue
        took = []
        for _ in range(runs):
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t)
        times[name] = round(median(took), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
