"""Column helpers for unsigned 64-bit keys.

Spark has no unsigned integers. A key is held *biased*: the signed value ``u - 2**63``,
which sorts like ``u``, fits eight bytes and keeps Parquet min/max statistics usable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIAS = 1 << 63
HEADER_BYTES = 12


def bias(u: int) -> int:
    """The biased form of an unsigned Python integer."""
    if not 0 <= u < 1 << 64:
        raise ValueError(f"not an unsigned 64-bit value: {u}")
    return u - BIAS


def unbias(k: int) -> int:
    return k + BIAS


def bias_decimal(u: Column) -> Column:
    """DECIMAL(20,0) unsigned value -> biased BIGINT."""
    return (u.cast("decimal(20,0)") - F.lit(str(BIAS)).cast("decimal(20,0)")).cast("bigint")


def unbias_decimal(k: Column) -> Column:
    """Biased BIGINT -> DECIMAL(20,0) unsigned value, for display and interchange only."""
    return (k.cast("decimal(20,0)") + F.lit(str(BIAS)).cast("decimal(20,0)")).cast("decimal(20,0)")


def md5_u64(c: Column) -> Column:
    """A full-range unsigned key (as DECIMAL(20,0)) from the first 16 hex digits of an md5."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 16), 16, 10).cast("decimal(20,0)")


def payload_bytes(payload: Column) -> Column:
    return F.octet_length(payload).cast("bigint")


def record_bytes(payload: Column) -> Column:
    """On-disk size of a record: header plus payload."""
    return (F.octet_length(payload) + F.lit(HEADER_BYTES)).cast("bigint")


def clamp(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(v, lo), hi)
