"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("l2_topk", "knn_join", "topk_per_label", "maxsim_topk", "maxsim_two_stage", "ivf_full_probe_topk", "ivf_topk", "graph_topk", "rabitq8_topk", "tensor_source_rerank")
RUNS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{scratch}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from spherion import catalog

    found = catalog.queries()
    times, pairs = {}, 0
    try:
        for name in HEADLINE:
            runs = []
            for _ in range(RUNS):
                start = time.perf_counter()
                found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - start)
            times[name] = round(statistics.median(runs), 3)
        pairs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() ** 2
    finally:
        spark.stop()
        shutil.rmtree(scratch, ignore_errors=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "knn_join_pairs_per_sec": round(pairs / times["knn_join"])}))


if __name__ == "__main__":
    main()
