"""Bytes <-> Arrow batches of the record format: u64 key, u32 length, payload, little endian, nothing else."""

from __future__ import annotations

import struct
from collections.abc import Generator, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa

from keytide.functions.keys import BIAS, HEADER_BYTES

_HEADER, _SIZE = struct.Struct("<QI"), struct.Struct("<I")
#: What a scan of keys alone reads at a time; payloads that reach beyond it are passed over.
KEY_BLOCK = 64 << 10
SCHEMA = pa.schema([pa.field("key", pa.int64(), False), pa.field("payload", pa.binary(), False)])


class TruncatedRecord(ValueError):
    """The data, or the range between two cuts, end inside a record."""


def encode(key: int, payload: bytes) -> bytes:
    """One record from a biased key."""
    return _HEADER.pack(key + BIAS, len(payload)) + payload


def encode_batch(batch: pa.RecordBatch) -> bytes:
    """All records of a batch, in whole arrays: headers and payloads are scattered into one buffer."""
    n = batch.num_rows
    if not n:
        return b""
    keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
    payload = batch.column("payload").fill_null(b"").cast(pa.large_binary())
    offs = np.frombuffer(payload.buffers()[1], np.int64)[payload.offset : payload.offset + n + 1]
    head = np.empty(n, dtype=[("key", "<u8"), ("size", "<u4")])
    head["key"], head["size"] = keys.view(np.uint64) ^ np.uint64(BIAS), np.diff(offs)
    at = (offs[:-1] - offs[0]) + HEADER_BYTES * np.arange(n)
    out = np.empty(HEADER_BYTES * n + int(offs[-1] - offs[0]), dtype=np.uint8)
    body = np.ones(len(out), dtype=bool)
    raw = head.view(np.uint8).reshape(n, HEADER_BYTES)
    for j in range(HEADER_BYTES):
        out[at + j] = raw[:, j]
        body[at + j] = False
    if payload.buffers()[2] is not None:
        out[body] = np.frombuffer(payload.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return out.tobytes()


def record_offsets(buf: bytes | memoryview, end: int) -> tuple[list[int], int]:
    """Starts of the whole records in buf[:end], and where the first incomplete one begins."""
    at, starts, size_at = 0, [], _SIZE.unpack_from
    add, last = starts.append, end - HEADER_BYTES
    while at <= last:
        stop = at + HEADER_BYTES + size_at(buf, at + 8)[0]
        if stop > end:
            break
        add(at)
        at = stop
    return starts, at


def to_batch(buf: bytes, starts: list[int], stop: int, keys_only: bool = False) -> pa.RecordBatch:
    """Whole records as an Arrow batch; payloads are gathered into one buffer, not into a list of bytes."""
    raw = np.frombuffer(buf, dtype=np.uint8)
    at = np.asarray(starts, dtype=np.int64)
    head = raw[at[:, None] + np.arange(8)] if len(at) else np.zeros((0, 8), np.uint8)
    keys = (np.ascontiguousarray(head).view("<u8").ravel() ^ np.uint64(BIAS)).view(np.int64)
    if keys_only:
        return pa.RecordBatch.from_arrays([pa.array(keys)], schema=pa.schema([SCHEMA.field("key")]))
    ends = np.append(at[1:], stop) if len(at) else at
    lengths = ends - at - HEADER_BYTES
    keep = np.ones(stop, dtype=bool)
    for j in range(HEADER_BYTES):
        keep[at + j] = False
    data = raw[:stop][keep]
    offsets = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    payload = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(keys), payload.cast(pa.binary())], schema=SCHEMA)


def decode_stream(
    f: BinaryIO, start: int, end: int, block_bytes: int = 4 << 20, strict: bool = True, keys_only: bool = False
) -> Iterator[pa.RecordBatch]:
    """Batches of the records in [start, end). A record larger than a block makes the block grow.

    A cut-off last record raises in strict mode and is left out otherwise.
    """
    if keys_only:
        yield from _keys(f, start, end, strict)
        return
    f.seek(start)
    left, buf = end - start, b""
    while left > 0 or buf:
        more = f.read(min(max(block_bytes, 1), left)) if left > 0 else b""
        left -= len(more)
        if not more:
            left = 0
        buf += more
        starts, stop = record_offsets(buf, len(buf))
        if starts:
            yield to_batch(buf, starts, stop)
        buf = buf[stop:]
        if left <= 0:
            if buf and strict:
                raise TruncatedRecord(f"{len(buf)} bytes at the end are not a whole record")
            return
        if not starts:
            block_bytes = max(block_bytes * 2, HEADER_BYTES)


def _keys(f: BinaryIO, start: int, end: int, strict: bool) -> Generator[pa.RecordBatch, None, int]:
    """Keys of the records in [start, end): small records are read in blocks, what a payload has beyond its block is not read. Returns the bytes left over."""
    at = start
    while at < end:
        f.seek(at)
        buf = f.read(min(KEY_BLOCK, end - at))
        place, starts = 0, []
        while place + HEADER_BYTES <= len(buf):
            size = HEADER_BYTES + _SIZE.unpack_from(buf, place + 8)[0]
            if at + place + size > end:
                break
            starts.append(place)
            place += size
        if starts:
            yield to_batch(buf, starts, len(buf), True)
        elif strict:
            raise TruncatedRecord(f"{end - at} bytes at the end are not a whole record")
        else:
            break
        at += place
    return end - at


def count_range(f: BinaryIO, start: int, end: int) -> tuple[int, int]:
    """(whole records, bytes of a cut-off last record) of [start, end), without reading payloads."""
    walk, n = _keys(f, start, end, False), 0
    while True:
        try:
            n += next(walk).num_rows
        except StopIteration as done:
            return n, done.value
