"""Columnar exchange of (hash, row, position) entries: which occurrences repeat?

Entries travel packed, a blob for each source flush and bucket of the hash, so the shuffle moves
about 20 bytes an entry and no row objects. Before sending, equal hashes of one flush are
merged: one representative goes to the hash's bucket, the others are known to repeat and go, by
row, to any bucket. So a hash that a third of all rows share puts no more than one entry a
flush on its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

FLUSH = 1 << 20
BLOB = "bucket int, n bigint, h binary, who binary"
_BLOB_SCHEMA = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("h", pa.binary()), ("who", pa.binary())])
_U = np.uint64


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def pack(buckets: np.ndarray, h1: np.ndarray | None, h2: np.ndarray | None, key: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blobs by bucket; without hashes (None) the entries are known and only pass through."""
    order = np.argsort(buckets.astype(np.uint16) if len(buckets) and buckets.max() < 65536 else buckets, kind="stable")
    b, key, at = buckets[order], key[order].astype(np.int64), at[order].astype(np.int64)
    h1, h2 = (h1[order].astype(_U), h2[order].astype(np.uint32)) if h1 is not None else (None, None)
    cuts = np.concatenate([[0], np.nonzero(np.diff(b))[0] + 1, [len(b)]]) if len(b) else np.zeros(1, np.int64)
    rows = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        step = np.diff(key[i:j], prepend=0)
        rows.append((int(b[i]), j - i, h1[i:j].tobytes() + h2[i:j].tobytes() if h1 is not None else b"", _squeeze(step, at[i:j])))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _BLOB_SCHEMA, strict=True)], schema=_BLOB_SCHEMA)


def unpack(batches: Iterator[pa.RecordBatch]) -> tuple[list, list]:
    """((h1, h2, key, at) pieces, (key, at) pieces that pass through)."""
    hashed, known = [], []
    for batch in batches:
        for n, h, who in zip(batch.column("n").to_pylist(), batch.column("h"), batch.column("who"), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(who.as_py())
            key, at = np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.int64, n, 8 * n)
            hb = h.as_py()
            if hb:
                hashed.append((np.frombuffer(hb, _U, n), np.frombuffer(hb, np.uint32, n, 8 * n), key, at))
            else:
                known.append((key, at))
    return hashed, known


def _row_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    x = key.astype(_U) * _U(0x9E3779B97F4A7C15)
    return ((x >> _U(33)) % _U(buckets)).astype(np.int64)


def _groups(h1: np.ndarray, h2: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash (then row and position), and where groups begin in it."""
    order = np.lexsort((at, key, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


class Sender:
    """Collects entries of one task; flushes merge equal hashes before anything is sent. With ``mark``, see ``repeated``."""

    def __init__(self, buckets: int, later_only: bool, mark: bool = False) -> None:
        self.buckets, self.later_only, self.mark, self.held, self.n = buckets, later_only, mark, [], 0

    def add(self, h1: np.ndarray, h2: np.ndarray, key: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((h1, h2.astype(np.uint32), key, at))
        self.n += len(h1)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h1, h2, key, at = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order, new = _groups(h1, h2, key, at)
        rest = order[~new]
        first = np.sort(order[new])
        known = at * 2 + 1 if self.mark else at
        if not self.later_only and len(rest):
            # the representative repeats too
            sizes = np.diff(np.append(np.nonzero(new)[0], len(order)))
            lead = order[new][sizes > 1]
            rest = np.concatenate([rest, lead])
            if self.mark:
                known[lead] -= 1
        yield from pack((h1[first] % _U(self.buckets)).astype(np.int64), h1[first], h2[first], key[first], at[first])
        if len(rest):
            rest = np.sort(rest)
            yield from pack(_row_bucket(key[rest], self.buckets), None, None, key[rest], known[rest])


def _resolve(buckets: int, later_only: bool, mark: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, known = unpack(batches)
        if hashed:
            h1, h2, key, at = (np.concatenate(x) for x in zip(*hashed, strict=True))
            order, new = _groups(h1, h2, key, at)
            if later_only:
                flagged = order[~new]
            else:
                alone = new & np.append(new[1:], True)
                flagged = order[~alone]
                if mark:
                    at = at * 2
                    at[order[~new]] += 1
            known.append((key[flagged], at[flagged]))
        if known:
            key, at = (np.concatenate(x) for x in zip(*known, strict=True))
            for i in range(0, len(key), 4 * FLUSH):
                k, a = key[i : i + 4 * FLUSH], at[i : i + 4 * FLUSH]
                order = np.lexsort((a, k))
                yield from pack(_row_bucket(k[order], buckets), None, None, k[order], a[order])

    return run


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, positions in order, without repeats)."""
    _, known = unpack(batches)
    if not known:
        return
    key, at = (np.concatenate(x) for x in zip(*known, strict=True))
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    if len(key):
        keep = np.ones(len(key), dtype=bool)
        keep[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
        key, at = key[keep], at[keep]
    first = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1]) if len(key) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(key)) if len(key) else first
    for i in range(0, len(first), 512):
        f, e = first[i : i + 512], ends[i : i + 512]
        offs = np.append(f, e[-1]) - f[0]
        lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(at[f[0] : e[-1]], pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(key[f]), lists], names=["row_key", "at"])


def by_row(blobs: DataFrame, buckets: int) -> DataFrame:
    return blobs.repartition(buckets, "bucket").mapInArrow(_by_row, "row_key bigint, at array<bigint>")


def repeated(entries: DataFrame, buckets: int, later_only: bool = False, mark: bool = False) -> DataFrame:
    """Blobs from Senders -> (row_key, at): positions whose hash occurs again, or, with later_only, that are not its first.

    With mark (here and in the Senders) positions come doubled, and one more for those that are not
    the first of all (by row and position); one may then come both ways, and that it is not the first holds.
    """
    return by_row(entries.repartition(buckets, "bucket").mapInArrow(_resolve(buckets, later_only, mark), BLOB), buckets)


def bucket_count(df: DataFrame) -> int:
    """One bucket a shuffle partition: set spark.sql.shuffle.partitions to the input's size, as for any shuffle."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
