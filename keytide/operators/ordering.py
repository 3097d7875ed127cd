"""Sorts, ordered merges, runs and splits as plans that Spark partitions and spills by itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.workspace import materialise


def global_sort(df: DataFrame, *by: str) -> DataFrame:
    """One range exchange and a sort in each partition; give tie-breakers after the key to split hot keys too."""
    return df.orderBy(*(by or ("key",)))


def range_sort(df: DataFrame, parts: int, *by: str) -> DataFrame:
    """The same with a fixed number of partitions, in key order from one partition to the next."""
    by = by or ("key",)
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def _placed(df: DataFrame) -> DataFrame:
    """The rows, written once, with their partition and their place in it."""
    return materialise(df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))


def _before(placed: DataFrame, weight: Column) -> DataFrame:
    """(_part, _base): what the partitions before each one add up to; the driver folds one number a partition."""
    offsets, at = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(weight.cast("bigint").alias("n")).collect()):
        offsets.append((part, at))
        at += n
    return placed.sparkSession.createDataFrame(offsets, "_part int, _base bigint")


def stored_rank(df: DataFrame, rank: str = "rank") -> DataFrame:
    """1-based position of each row in the order in which partitions and their rows stand: nothing is sorted."""
    placed = _placed(df)
    return placed.join(F.broadcast(_before(placed, F.count("*"))), "_part").select(*df.columns, (F.col("_base") + F.col("_at") + 1).alias(rank))


def global_rank(df: DataFrame, parts: int, *by: str, rank: str = "rank") -> DataFrame:
    """1-based position in the total order, without sending all rows through one partition.

    Rows are sorted and written once; sizes of the partitions (one number each) give every
    partition its offset. Counting and ranking read the same written rows, so sampled range
    bounds cannot differ between the two.
    """
    return stored_rank(range_sort(df, parts, *by), rank)


def running_total(df: DataFrame, parts: int, size: str, *by: str, total: str = "upto") -> DataFrame:
    """Sum of ``size`` over the rows up to and with each one, in order of ``by``: a sum inside each partition, and one number for what is before it."""
    placed = _placed(range_sort(df, parts, *by))
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumn("_sum", F.sum(size).over(w))
    return inner.join(F.broadcast(_before(placed, F.sum(size))), "_part").select(*df.columns, (F.col("_base") + F.col("_sum")).cast("bigint").alias(total))


def run_sort(df: DataFrame, run: Column, *by: str) -> DataFrame:
    """Position of each row inside its run."""
    w = Window.partitionBy("run_id").orderBy(*by)
    return df.withColumn("run_id", run).withColumn("run_rank", F.row_number().over(w).cast("bigint"))


def merge(runs: Sequence[DataFrame], *by: str) -> DataFrame:
    """Ordered UNION ALL of any number of inputs (none: an error); one exchange however many there are."""
    if not runs:
        raise ValueError("nothing to merge")
    out = runs[0]
    for x in runs[1:]:
        out = out.unionByName(x)
    return out.orderBy(*(by or ("key",)))


def merge_two_stable(a: DataFrame, b: DataFrame, pos: str, *by: str) -> DataFrame:
    """Rows of ``a`` come first among equal keys."""
    by = by or ("key",)
    both = a.withColumn("src", F.lit(0)).unionByName(b.withColumn("src", F.lit(1)))
    return both.orderBy(*by, "src", pos)


def tree_merge(runs: Sequence[DataFrame], *by: str) -> DataFrame:
    """Pairwise rounds of unions, ordered once at the end."""
    level = list(runs)
    if not level:
        raise ValueError("nothing to merge")
    while len(level) > 1:
        level = [x.unionByName(level[i + 1]) if (i := 2 * k) + 1 < len(level) else x for k, x in enumerate(level[::2])]
    return level[0].orderBy(*(by or ("key",)))


def run_of(end_bytes: Column, budget: int) -> Column:
    """The run a record falls in, from the bytes up to its end and the run's byte budget."""
    return F.floor((end_bytes - 1) / budget).cast("bigint")


def split_of(start_bytes: Column, total: Column, parts: int) -> Column:
    """The byte range a record falls in: how many of the targets floor(total * i / parts), i >= 1, are at or before its start."""
    out = F.lit(0).cast("bigint")
    for i in range(1, parts):
        out = out + (start_bytes >= F.floor(total * i / parts)).cast("bigint")
    return out
