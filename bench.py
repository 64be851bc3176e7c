"""Time the headline queries, the median of some runs each; prints one JSON line."""

import json
import os
import time
from statistics import median

from geoquarry.session import build_session

RUNS = 3
HEADLINE = (
    "f1_viewport", "f2_sql_filter", "f6_semi", "p2_area", "p3_bounds", "p4_utm_roundtrip",
    "p6_unique_id_file", "p9_split_index", "j1_join_layers", "j3_join_keys", "j5_point_in_box",
    "j5_overlap_ratio", "j5_overlap_geometry", "j5_large_polygons", "u1_union_relaxed", "a5_mode", "a10_median_rule",
    "a12_agg_broadcast", "a14_profile", "w3_sample_one_layer", "c1_breaks", "c1_breaks_refined",
    "c3_classes", "c6_categorical", "r1_raster_bounds", "r5_normalise", "r6_nan_fill", "r9_rgb",
    "s2_match_terms", "s4_dataset_rollup", "s15_prune_files", "s15_zone_map", "k1_features", "k3_saved_view",
    "sql_group_by", "sql_window",
)


def main() -> None:
    import suite

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(
        os.environ.get("BENCH_CPUS", "8"), "bench", **{"spark.ui.showConsoleProgress": "false"}
    )
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("k1_features", "c3_classes", "j5_point_in_box"):
            suite.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
