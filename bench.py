"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaitworks.plans import catalog  # noqa: E402
from gaitworks.session import local_session  # noqa: E402

HEADLINE = [
    "feature_stats", "feature_stats_frames", "episode_stats", "masked_stats", "relative_action_stats", "delta_timestamp_window",
    "action_chunk", "relative_chunk", "normalise_q99", "stats_join_normalise", "nearest_asof_join", "span_interval_join",
    "global_frame_index", "merge_packs", "mixture_sample", "pack_shards_sequential", "dct_quantise", "openloop_error",
    "latency_percentiles", "resample_linear", "stream_running_stats",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # one small query first, so that JVM start-up is not charged to the first headline
    catalog.QUERIES["task_group_report"](spark, d).write.format("noop").mode("overwrite").save()
    # a cold round, whose times hold planning and code generation, and a warm one
    times, warm = {}, {}
    for into in (times, warm):
        for name in HEADLINE:
            start = time.perf_counter()
            catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            into[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", d)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "warm": warm, "warm_value": round(sum(warm.values()), 3), "sf": float(sf.group(1)) if sf else d,
    }))


if __name__ == "__main__":
    main()
