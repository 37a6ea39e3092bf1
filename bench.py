"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import time

from logweave.plans import catalog
from logweave.session import local_session

HEADLINE = [
    "log_seq_range", "log_time_range", "log_by_publisher", "replay_hlc_range", "replay_key_prefix", "replay_all", "gc_before",
    "compact_keyed", "latest_by_keys", "publisher_watermarks", "gap_detector", "event_id_dedup", "is_durable", "consumer_lag",
    "offset_fencing", "hrw_assign", "replicas_rack_aware", "invariant_report", "slow_consumer_debounce", "dlq_outcomes",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    noop = lambda name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    noop("log_scan")  # starts the JVM's compilers and reads the footers
    seconds = {}
    for name in HEADLINE:
        noop(name)
        seconds[name] = min(timed(lambda name=name: noop(name)) for _ in range(2))
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total time of headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
