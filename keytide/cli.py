"""python -m keytide.cli sort|gen|verify|sweep ...: the command line over record files. A failed verification exits with 1.

``sweep`` sorts each size with each number of workers, every run in a session of its own, and prints times, speedup and efficiency;
data sets that are there already are used again.
"""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys

from pyspark.sql import SparkSession

from keytide.operators.metrics import StageClock, last_execution, plan_metrics, scaling
from keytide.operators.ordering import range_sort
from keytide.operators.verify import multiset_digest, verify_order
from keytide.sources.datagen import generate
from keytide.sources.recordfile import concat_parts, list_record_files, register


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="keytide")
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("sort")
    s.add_argument("source")
    s.add_argument("target")
    s.add_argument("--split-mb", type=int, default=128, help="bytes read by one task")
    s.add_argument("--parts", type=int, default=0, help="partitions of the range exchange")
    s.add_argument("--expect", type=int, help="records that the output must have")
    s.add_argument("--single", help="also write all parts, in order, to this one file")
    s.add_argument("--lenient", action="store_true", help="leave out cut-off last records and say how many")
    s.add_argument("--metrics", action="store_true", help="also print the metrics of the executed plans")
    w = sub.add_parser("sweep")
    w.add_argument("folder", help="where data sets and results go")
    w.add_argument("--sizes", default="1000000", help="numbers of records, with commas")
    w.add_argument("--max-payload", type=int, default=16)
    w.add_argument("--workers", default="1,2,4,8", help="numbers of workers, with commas")
    w.add_argument("--master", default="local[{workers}]", help="master of a run")
    w.add_argument("--conf", action="append", default=[], help="key=value for every run; {workers} is replaced")
    g = sub.add_parser("gen")
    g.add_argument("target")
    g.add_argument("n", type=int)
    g.add_argument("max_payload", type=int)
    g.add_argument("--splits", type=int, default=1)
    g.add_argument("--seed", type=int, default=0)
    v = sub.add_parser("verify")
    v.add_argument("source")
    v.add_argument("--expect", type=int)
    v.add_argument("--split-mb", type=int, default=128, help="bytes read by one task")
    a = p.parse_args(argv)
    if min(getattr(a, "split_mb", 1), getattr(a, "splits", 1), getattr(a, "max_payload", 8) - 7, getattr(a, "n", 0) + 1) < 1:
        p.error("sizes and counts must be positive, payloads of 8 bytes at least")
    if a.cmd == "sweep":
        return sweep(a, spark)
    spark = spark or SparkSession.builder.appName("keytide").getOrCreate()
    register(spark)
    clock = StageClock()
    if a.cmd == "gen":
        rows = generate(spark, a.n, a.max_payload, a.seed, splits=a.splits).select("key", "payload")
        rows.write.format("recordfile").mode("overwrite").option("path", a.target).save()
        return 0
    if a.cmd == "sort":
        source = spark.read.format("recordfile").option("split_bytes", a.split_mb << 20).option("strict", str(not a.lenient).lower())
        if a.lenient:
            dropped = spark.read.format("recordfile").option("split_bytes", a.split_mb << 20).option("tails", "true").load(a.source).agg({"dropped": "sum"}).first()[0]
            print("cut-off records left out:", dropped or 0)
        rows, mark = source.load(a.source), last_execution(spark)
        parts = a.parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        with clock.stage("sort"):
            range_sort(rows, parts, "key", "payload").write.format("recordfile").mode("overwrite").option("path", a.target).save()
        with clock.stage("verify"):
            out = spark.read.format("recordfile").load(a.target)
            same = multiset_digest(rows).first() == multiset_digest(out).first()
            # partitions come in order of file and start
            report = verify_order(spark.read.format("recordfile").option("keys_only", "true").load(a.target), expected_count=a.expect)
        if a.single:
            with clock.stage("concat"):
                concat_parts(a.target, a.single)
        if a.metrics:
            plan_metrics(spark, mark).show(1000, truncate=False)
        clock.report(spark).show(truncate=False)
        print(json.dumps({"seconds": clock.stages}))
        print(report, "same records:", same)
        return int(not (report.ok and same))
    report = verify_order(spark.read.format("recordfile").option("keys_only", "true").option("split_bytes", a.split_mb << 20).load(a.source), expected_count=a.expect)
    print(report)
    return int(not report.ok)


def sweep(a: argparse.Namespace, spark: SparkSession | None) -> int:
    """Runs of ``sort`` in processes of their own; the table goes to the output and, as JSON, into the folder."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": os.pathsep.join([here, os.environ.get("PYTHONPATH", "")])}
    rows = []
    for n in (int(x) for x in a.sizes.split(",")):
        data = f"{a.folder}/data-{n}-{a.max_payload}"
        for workers in (int(x) for x in a.workers.split(",")):
            conf = {"spark.master": a.master, "spark.ui.enabled": "false", **dict(c.split("=", 1) for c in a.conf)}
            args = " ".join(f"--conf {k}={v.format(workers=workers)}" for k, v in conf.items())
            run = env | {"PYSPARK_SUBMIT_ARGS": f"{args} pyspark-shell"}
            command = [sys.executable, "-m", "keytide.cli"]
            try:
                list_record_files(data)
            except FileNotFoundError:
                subprocess.run([*command, "gen", data, str(n), str(a.max_payload), "--splits", str(workers)], env=run, check=True)
            done = subprocess.run([*command, "sort", data, f"{data}-sorted", "--parts", str(workers), "--expect", str(n)], env=run, stdout=subprocess.PIPE, text=True)
            if done.returncode:
                print(done.stdout)
                return done.returncode
            seconds = next(json.loads(x)["seconds"]["sort"] for x in done.stdout.splitlines() if x.startswith('{"seconds"'))
            rows.append((f"{n}x{a.max_payload}", workers, seconds))
    spark = spark or SparkSession.builder.appName("keytide").getOrCreate()
    table = scaling(spark.createDataFrame(rows, "variant string, workers int, seconds double")).orderBy("variant", "workers")
    found = [r.asDict() for r in table.collect()]
    table.show(1000, truncate=False)
    with open(f"{a.folder}/sweep.json", "w") as f:
        json.dump(found, f)
    return 0


if __name__ == "__main__":
    sys.exit(main())
