"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "q1_frames_at_point q3_frames_in_view q4_frame_neighbours t5_copies t8_ground_track a1_season_report a3_azimuth_report e3_outcomes "
    "n9_utc_agrees p2_ground_to_pixel p9_terrain_height p17_needed_frames m18_hit_test c13_height_ranges i3_region_plan k2_grid_to_lonlat"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from aerolens.catalog import load
    from aerolens.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    # A first run of each query writes the tables it shares with others and compiles; the second is the one that counts.
    first, times = {}, {}
    for into in (first, times):
        for name in HEADLINE:
            start = time.time()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            into[name] = round(time.time() - start, 3)
            print(name, into[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "first_run": first, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
