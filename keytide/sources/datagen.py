"""Seeded synthetic records: uniform unsigned keys, payload lengths uniform in [min, max], rotating-alphabet payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def payload_for(i: Column, length: Column, max_len: int) -> Column:
    """Byte j of record i is the letter at (i + j) modulo 26."""
    reps = max_len // len(ALPHABET) + 2
    return F.substring(F.lit(ALPHABET * reps), (F.pmod(i, F.lit(26)) + 1).cast("int"), length.cast("int"))


def generate(
    spark: SparkSession, n: int, max_payload: int, seed: int = 0, min_payload: int = 8, splits: int = 1
) -> DataFrame:
    """(i, split, key, payload). The rows depend on the seed alone, not on the partitioning.

    Partition s is split s: n // splits rows each, and what is left over in the last one.
    """
    splits = max(1, splits)
    span = max(1, max_payload - min_payload + 1)
    each = n // splits
    width = each + n % splits  # the last split's rows; the others leave the rest of theirs out
    at, split = F.pmod(F.col("id"), F.lit(max(1, width))), F.floor(F.col("id") / F.lit(max(1, width))).cast("bigint")
    rows = spark.range(0, width * splits, 1, splits).select(split.alias("split"), at.alias("at"))
    rows = rows.filter((F.col("at") < each) | (F.col("split") == splits - 1)).select((F.col("split") * each + F.col("at")).alias("i"), "split")
    i = F.col("i")
    length = F.pmod(F.xxhash64(i, F.lit(seed), F.lit("len")), F.lit(span)) + min_payload
    return rows.select("i", "split", F.xxhash64(i, F.lit(seed), F.lit("key")).alias("key"), payload_for(i, length, max_payload).cast("binary").alias("payload"))
