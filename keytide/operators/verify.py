"""Is a dataset in key order, whole, and the same multiset as before?"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.functions.keys import unbias

_SUMMARY = "pid int, n bigint, first bigint, last bigint, violations bigint, bad_at bigint, bad_prev bigint, bad_cur bigint"


def _summarise(batches):
    from pyspark import TaskContext

    n, first, last, bad, at = 0, None, None, 0, None
    for b in batches:
        k = b.column(0).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        seen = k if last is None else np.concatenate([[last], k])
        drops = np.nonzero(seen[1:] < seen[:-1])[0]
        if len(drops):
            if at is None:
                i = int(drops[0])
                at = (n + i + (1 if last is None else 0), int(seen[i]), int(seen[i + 1]))
            bad += len(drops)
        first, last, n = (int(k[0]) if first is None else first), int(k[-1]), n + len(k)
    row = [[TaskContext.get().partitionId()], [n], [first], [last], [bad]] + [[x] for x in (at or (None, None, None))]
    types = [pa.int32()] + [pa.int64()] * 7
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in _SUMMARY.split(", ")])


@dataclass
class OrderReport:
    ok: bool
    count: int
    violations: int
    index: int | None = None
    previous: int | None = None
    current: int | None = None
    message: str = "SUCCESS"


def verify_order(df: DataFrame, key: str = "key", expected_count: int | None = None, unsigned: bool = True) -> OrderReport:
    """Each partition reports a summary; the driver folds one row per partition, in partition order."""
    rows = sorted(df.select(F.col(key).cast("bigint").alias("key")).mapInArrow(_summarise, _SUMMARY).collect(), key=lambda r: r["pid"])
    count = violations = 0
    last = index = prev = cur = None
    for r in rows:
        if not r["n"]:
            continue
        if last is not None and r["first"] < last:
            violations += 1
            if index is None:
                index, prev, cur = count, last, r["first"]
        if r["violations"] and index is None:
            index, prev, cur = count + r["bad_at"], r["bad_prev"], r["bad_cur"]
        violations += r["violations"]
        count, last = count + r["n"], r["last"]
    show = (lambda x: unbias(x) if x is not None and unsigned else x)
    if violations:
        return OrderReport(False, count, violations, index, show(prev), show(cur), "Order violation")
    if expected_count is not None and count != expected_count:
        return OrderReport(False, count, 0, message="Count mismatch")
    return OrderReport(True, count, 0)


def multiset_digest(df: DataFrame, *cols: str) -> DataFrame:
    """One row (n, hash_sum, hash_xor) that two datasets share if they hold the same rows, in any order."""
    h = F.xxhash64(*(cols or df.columns))
    return df.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"),
        F.coalesce(F.bit_xor(h), F.lit(0).cast("bigint")).alias("hash_xor"),
    )


def same_multiset(a: DataFrame, b: DataFrame, *cols: str) -> bool:
    return multiset_digest(a, *cols).first() == multiset_digest(b, *cols).first()
