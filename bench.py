"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores. Each query
runs once after a short warm-up; its time covers planning and full evaluation of every output column. The total
includes the warm-up, which writes the prepared table the queries read.
"""

from __future__ import annotations

import json
import os
import time

from cityloom.plans.catalog import QUERIES
from cityloom.session import build_session

HEADLINE = [
    "l5_master",
    "a5_coverage",
    "a7_rule_accuracy",
    "j1_parcel_join",
    "j2_supertall_overlap",
    "j3_best_overlap",
    "j4_centroid_pairs",
    "j5_label_match",
    "j6_nearest_building",
    "j8_neighbour_pairs",
    "j9_nearest_neighbour",
    "j10_same_model_pairs",
    "j11_same_model_clusters",
    "a1_band_table",
    "a10_poi_votes",
    "a19_neighbour_stats",
    "b2_shape_features",
    "b4_parcel_features",
    "a22_cell_metadata",
    "a27_scope_diagnostics",
    "a30_accuracy_by_scope",
    "r4_bootstrap_interval",
    "c3_monthly_comparison",
    "d3_embodied_carbon",
    "p1_clip_pixels",
    "p3_pixel_stats",
    "p6_incremental_ingest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("cityloom-bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up: JVM and Python workers, and the prepared footprint table the queries read
    t0 = time.perf_counter()
    QUERIES["g2_compactness"](spark, folder).write.format("noop").mode("overwrite").save()
    QUERIES["w2_best_row_per_key"](spark, folder).write.format("noop").mode("overwrite").save()
    prepare = time.perf_counter() - t0
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()) + prepare, 3),
                "unit": "sec",
                "queries": times,
                "prepare_sec": round(prepare, 3),
                "queries_sec": round(sum(times.values()), 3),
                "sf": sf,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
