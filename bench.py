"""Time the registered core queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from keytide.operators.ordering import range_sort
    from keytide.plans.queries import QUERIES
    from keytide.sources.datagen import generate
    from keytide.sources.recordfile import register

    times: dict[str, float] = {}
    QUERIES["top_keys"](spark, sf).collect()  # start-up is not a query's time
    for name, f in QUERIES.items():
        t = time.perf_counter()
        f(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    for name, n, size in (("records_2m_16b", 2_000_000, 16), ("records_1m_128b", 1_000_000, 128)):
        rows = generate(spark, n, size, splits=int(cpus)).select("key", "payload")
        t = time.perf_counter()
        range_sort(rows, int(cpus), "key").write.format("noop").mode("overwrite").save()
        times[f"sort_{name}"] = round(time.perf_counter() - t, 3)
    # the published runs: record files read, sorted and written as record files
    register(spark)
    for name, n, size in (("10m_16b", 10_000_000, 16), ("20m_16b", 20_000_000, 16), ("10m_128b", 10_000_000, 128)):
        source, target = f"{shared}/in-{name}", f"{shared}/out-{name}"
        generate(spark, n, size, splits=int(cpus)).select("key", "payload").write.format("recordfile").mode("overwrite").option("path", source).save()
        t = time.perf_counter()
        rows = spark.read.format("recordfile").option("split_bytes", 32 << 20).load(source)
        range_sort(rows, int(cpus), "key").write.format("recordfile").mode("overwrite").option("path", target).save()
        times[f"file_sort_{name}"] = round(time.perf_counter() - t, 3)
        shutil.rmtree(source)
        shutil.rmtree(target)
    print(json.dumps({"metric": "total wall time of the core queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
