"""Stage times, speedup and efficiency as a table."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class StageClock:
    """Wall seconds by stage; ``unaccounted`` is what the total has beyond the stages."""

    def __init__(self) -> None:
        self.stages: dict[str, float] = {}
        self._began = time.perf_counter()

    @contextmanager
    def stage(self, name: str):
        t = time.perf_counter()
        try:
            yield
        finally:
            self.stages[name] = self.stages.get(name, 0.0) + time.perf_counter() - t

    def report(self, spark: SparkSession) -> DataFrame:
        total = time.perf_counter() - self._began
        rows = [*self.stages.items(), ("unaccounted", total - sum(self.stages.values())), ("total", total)]
        return spark.createDataFrame(rows, "stage string, seconds double")


def last_execution(spark: SparkSession) -> int:
    """Id of the newest SQL execution, -1 if there is none: a mark for ``plan_metrics``."""
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)


def plan_metrics(spark: SparkSession, after: int = -1) -> DataFrame:
    """(execution, operator, metric, value) of the executed plans newer than ``after``, as Spark shows them: sort times, spill, shuffled bytes.

    Asks Spark's status store on the driver, whose size does not depend on the data; needs a classic (not a Connect) session.
    """
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs, rows = store.executionsList(), []
    for e in (runs.apply(i).executionId() for i in range(runs.size())):
        if e <= after:
            continue
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                v = values.get(m.accumulatorId())
                if v.isDefined():
                    rows.append((e, node.name(), m.name(), v.get()))
    return spark.createDataFrame(rows, "execution bigint, operator string, metric string, value string")


def scaling(df: DataFrame) -> DataFrame:
    """(variant, workers, seconds) -> speedup against the variant's one-worker time, and efficiency."""
    base = F.max(F.when(F.col("workers") == 1, F.col("seconds"))).over(Window.partitionBy("variant"))
    speedup = base / F.col("seconds")
    return df.select("*", speedup.alias("speedup"), (speedup / F.col("workers")).alias("efficiency"))


def phases(df: DataFrame) -> DataFrame:
    """(run, worker, phase, seconds) -> the slowest worker and the summed work of each phase."""
    return df.groupBy("run", "phase").agg(F.max("seconds").alias("wall_seconds"), F.sum("seconds").alias("work_seconds"))
