"""Time the headline queries on one machine; prints one line of JSON.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run once to warm up and then timed; all rows are computed and thrown away.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from twinweave.plans.catalog import QUERIES  # noqa: E402
from twinweave.session import get_session  # noqa: E402

HEADLINE = (
    "j1_interval_click_view", "j1_interval_orders_lineitem", "j4_tumbling_join", "j5_sliding_join",
    "j8_interval_data", "j9_interval_hybrid", "j9_interval_hybrid_heavy_first", "t3_stream_interval_hybrid", "j10_interval_bucket_few_keys", "j10_interval_auto_skewed",
    "j11_self_interval", "s8_replay", "w2_sampler", "a9_percentile_interp", "a7_latency_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("events", "orders", "lineitem")}

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    taken = {}
    for name in names:
        run(name)
        taken[name] = round(min(run(name) for _ in range(2)), 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    inputs = {n: rows["orders"] + rows["lineitem"] if "lineitem" in n else rows["events"] for n in taken}
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken,
        "sf": float(scale.group(1)) if scale else None,
        "rows_per_s": {n: round(inputs[n] / s) for n, s in taken.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
