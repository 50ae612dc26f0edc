"""Times headline queries: one JSON line with the median of the warm runs of each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HEADLINE = ("flagship", "agg_group", "agg_rollup", "agg_listagg", "join_three", "join_semi", "window_rank", "window_qualify", "topk", "cte", "fn_datediff_month", "fn_parse_json", "set_union", "correlated_subquery", "dml_update", "dml_merge", "join_asof", "dml_update_large", "dml_merge_large")
RUNS = 3


def main() -> None:
    os.chdir(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, os.getcwd())
    from pyspark.sql import SparkSession

    from heronbase import catalogue

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    top = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", f"{top}/warehouse")
        .config("spark.checkpoint.dir", f"{top}/checkpoint")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in HEADLINE:
        seconds = []
        for _ in range(RUNS + 1):  # the first compiles
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        took[name] = round(statistics.median(seconds[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
