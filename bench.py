"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from incidentlab.catalog import QUERIES
from incidentlab.session import build_session

HEADLINE = """
s2_profile s3_write_panel s4_ranked_csv s7_read_feature_lines s9_json_map_rows
c2_c5_handle_missing c3_impute_median c4_impute_mode c6_valid_coordinates c8_calendar_flags c19_classify_requests
j1_attach_unit_features j2_neighbor_mean j4_local_moran j5_adjacency j6_point_in_polygon j11_visible_rows j12_upsert
a1_unit_month_panel a2_cell_month_panel a4_unit_trend a11_station_load a12_unit_ranking a15_dashboard_metrics
a23_histogram a24_density_grid a25_correlation_matrix
w1_lags w2_rolling w3_ema w6_acceleration w10_expected_growth w11_risk_percentile w16_w17_risk_scores w18_hotspots
w19_apportion w22_capped_sample w23_category_mix
t2_alerts t5_dashboard f2_haversine f12_cell_index f13_cell_boundary f14_report_lifecycle
m1_build_risk_features m2_build_cell_features m3_fit_risk m6_fold_sizes m10_linear_attributions m11_local_drivers
m10_sampled_attributions m13_cluster v1_unique v8_weights_reconcile v_all_checks
r1_over_limit r1_over_limit_stream r2_live_metrics_stream r5_latest_by_key
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          spark__ui__enabled="false", spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a1_unit_month_panel"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the session
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(found.group(1)) if found else folder}))
    spark.stop()


if __name__ == "__main__":
    main()
