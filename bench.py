"""Time headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINES = ("merge_final_state", "latest_op_per_key", "replay_counters", "delete_route_split", "backfill_snapshot", "route_docs", "transform_nested_upper", "validation_counts", "aimd_trace", "batch_packing", "transition_history", "summary_projection", "list_migrations")


def main() -> None:
    from pyspark.sql import SparkSession

    from tidelog.queries import QUERIES

    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda q: QUERIES[q](spark, sf).write.format("noop").mode("overwrite").save()
    run(HEADLINES[0])  # the JVM warms up outside the figures
    took = {}
    for q in HEADLINES:
        began = time.time()
        run(q)
        took[q] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
