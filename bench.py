"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs to the end
through a no-op sink, so nothing is brought to the driver; the best of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegrid.plans import QUERIES  # noqa: E402
from tidegrid.plans.modelling import forget  # noqa: E402
from tidegrid.session import build_session  # noqa: E402

HEADLINE = (
    "flagship_presence_summary", "p3_rejection_waterfall", "a1_waterfall_counts", "d2_cross_source",
    "j1_daily_feature_grid", "j2_presence_match", "j3_nearest_point_rows", "j4_as_of_bounded", "j10_nearest_cell",
    "j11_bilinear", "j13_past_changes", "w6_grid_gradient", "w9_physics_features", "a5_daily_weather",
    "x2_same_day_background", "x4_strategy_samples", "x5_temporal_split", "x7_spatial_block_split",
    "w1_relative_score", "w2_strict_percentile", "w4_global_percentile", "w5_contrast_score",
    "m6_evaluation", "w10_top_share_hits", "w13_production_pick", "a11_score_distribution", "a14_bathymetry_audit",
    "t1_top_cells", "t3_stratified_export", "t5_screen_buckets", "w11_spaced_hotspots", "f10_rule_composite",
    "s8_html_links", "s15_serving_scan", "m2_preprocess", "m13_corrected_scoring",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            forget()
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
