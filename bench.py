"""Time the headline queries with a no-op sink; prints one JSON line.

Queries over derived bars build them from the generic tables each time. Those named warehouse_* read
and publish the same bars in a bucketed warehouse, whose set-up is not timed.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = [
    "bench_full_scan", "bench_cross_section", "bench_one_instrument", "session_return", "spike_event_study", "eod_features", "gap_candidates", "gap_study_flagship",
    "opening_metrics", "multiday_metrics", "propensity_two_pass", "q_zero_volume_runs", "alias_asof", "merge_upsert", "universe_rank",
]
FEW = 64  # instruments of a timed publication


def main() -> None:
    from pyspark.sql import functions as F

    from barlake.plans import registry
    from barlake.plans.frames import Frames, release
    from barlake.session import build_session
    from barlake.sources.warehouse import Warehouse

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    known, took = registry.queries(), {}

    def timed(name: str, run) -> None:
        start = time.time()
        out = run()
        if out is not None:
            out.write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)

    known["bench_full_scan"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up, not timed
    for name in HEADLINE:
        timed(name, lambda name=name: known[name](spark, folder))
    release()

    root = tempfile.mkdtemp(prefix="barlake-bench-")
    try:
        bars, store = Frames(spark, folder), Warehouse(spark, f"file://{root}")
        store.publish("eod", bars.long)
        store.publish("intraday_5min", bars.five)
        few = [r[0] for r in store.read("eod").select("instrument_id").distinct().orderBy("instrument_id").limit(FEW).collect()]
        one = store.read("intraday_5min").select("instrument_id").first()[0]
        update = store.read("eod", few, start="2001-10-01").withColumn("close", F.col("close") + 1)
        total = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.col("close") - F.col("open")).alias("move"), F.sum("volume").alias("volume"))
        timed("warehouse_full_scan", lambda: total(store.read("intraday_5min")))
        timed("warehouse_cross_section", lambda: store.read("intraday_5min", start="2024-01-10", end="2024-01-10").groupBy("instrument_id").agg(F.min_by("open", "ts"), F.max_by("close", "ts"), F.sum("volume")))
        timed("warehouse_one_instrument", lambda: total(store.read("intraday_5min", [one])))
        timed("warehouse_publish_64", lambda: store.publish("eod", update))
    finally:
        shutil.rmtree(root, ignore_errors=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
