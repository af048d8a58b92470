"""Wall time of the headline queries, as one JSON line. BENCH_SF_DIR and BENCH_CPUS say where and on how much."""

import json
import os
import time

from strandline.plans.catalogue import queries
from strandline.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["active_count_daily", "monotonic_gate", "rate_limit", "mobility_coverage_hourly", "activity_time_daily", "activity_episodes", "episode_distance", "window_stats", "geodiameter_daily", "place_state", "place_segments", "hmm_rectify", "segment_dedup", "split_by_day", "moves_coverage_hourly", "moves_activity_daily", "track_points", "latest_credential", "upsert_last", "mail_clean"]


def main() -> None:
    spark = local_session(CPUS, "bench")
    registered, cold, warm = queries(), {}, {}
    for name in HEADLINE:
        for times in (cold, warm):
            began = time.time()
            registered[name](spark, SF).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    settings = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone")}
    print(json.dumps({"metric": "total_seconds_warm", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": SF, "cpus": CPUS, "settings": settings}))


if __name__ == "__main__":
    main()
