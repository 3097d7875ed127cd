"""What the operators share: row keys, Arrow text blocks, vectorised words and hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators.ordering import global_rank
from keytide.workspace import materialise

#: Small enough for arrays of eight bytes a byte to stay in a core's cache.
BLOCK_BYTES = 1 << 18
BATCH_BYTES = 8 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes too: 10,000 rows of very long texts do not meet in one. A smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(c for c in spark.conf.get(name) if c.isdigit())) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _own_keys(docs: DataFrame, id_col: str) -> bool:
    """Whether ids are all there and all different; a repeated one is looked for by partial counts, one row an id."""
    n = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.filter("n > 1 or doc_id is null").limit(1).count() == 0


def numbered(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns and a unique key: the id, or if ids are missing or repeated the rank by id (nulls last) and text."""
    if _own_keys(docs, id_col):
        return docs.withColumn(name, F.col(id_col).cast("bigint"))
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = docs.withColumn("_none", F.col(id_col).isNull())
    return materialise(global_rank(d, parts, "_none", id_col, text_col, rank=name).drop("_none"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, doc_id, text): a unique key in the order of ids, null texts as empty ones.

    Ids that are all there and all different are their own keys. Otherwise rows are ranked by id
    (nulls first, then by text), so repeated rows stay apart.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if _own_keys(docs, id_col):
        return d.select(F.col("doc_id").alias("row_key"), "doc_id", "text")
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialise(global_rank(d, parts, "doc_id", "text", rank="row_key").select("row_key", "doc_id", "text"))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for b in batches:
        z = [c.compress(x.as_buffer()) if len(x.as_py()) else b"" for x in b.column(2).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], names=["row_key", "doc_id", "z"])


def squeezed(keyed_docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, z): texts compressed one by one, for exchanges that move whole texts."""
    return keyed_docs.select("row_key", "doc_id", "text").mapInArrow(_squeeze, "row_key bigint, doc_id bigint, z binary")


def unsqueeze(z: pa.Array) -> pa.Array:
    d = zstandard.ZstdDecompressor()
    return pa.array([d.decompress(x) if x else b"" for x in z.to_pylist()], pa.large_binary())


def text_blocks(ids: np.ndarray, texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of consecutive texts of about block_bytes together; a longer text is a block by itself."""
    arr = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if len(arr) == 0:
        return
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(arr):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + block_bytes, side="right")) - 1)
        yield ids[a:b], data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words of all texts; words of text k are first[k]:first[k + 1]."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cut = offs[(offs > 0) & (offs < n)]
    begins[cut] = solid[cut]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    stops[cut - 1] = solid[cut - 1]
    starts, ends = np.nonzero(begins)[0], np.nonzero(stops)[0] + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        base = _BASES[which]
        inv = np.uint64(pow(int(base), -1, 1 << 64))
        size = max(n, BLOCK_BYTES + 1)
        out = []
        for b in (base, inv):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1])
        if n <= 4 * BLOCK_BYTES:  # those of a single very long span do not stay in memory
            _powers[which] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit names of byte spans (in order of their starts), from a running sum over the block: equal bytes, equal name, wherever they stand."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        # a very long text is summed in stretches
        a = int(starts[i])
        j = len(starts) if len(data) - a <= BLOCK_BYTES else max(i + 1, int(np.searchsorted(starts, a + BLOCK_BYTES)))
        part = data[a : int(ends[i:j].max())]
        up, down = _pow(which, len(part) + 1)
        run = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=run[1:])
        s = starts[i:j] - a
        out[i:j] = mix((run[ends[i:j] - a] - run[s]) * down[s])
        i = j
    return out


def pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0x5851F42D4C957F2D)))


def gram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Name of each n consecutive values (len - n + 1 of them), by doubling."""
    total = len(words) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    cur, size, out, have, left = mix(words + np.uint64(salt * 2 + 1)), 1, None, 0, n
    while True:
        if left & 1:
            if out is None:
                out, have = cur, size
            else:
                m = min(len(out), len(cur) - have)
                out, have = pair_names(out[:m], cur[have : have + m]), have + size
        left >>= 1
        if not left:
            return out[:total]
        cur, size = pair_names(cur[:-size], cur[size:]), size * 2


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    cur, size = h, 1
    while size * 2 <= w:
        cur, size = np.minimum(cur[:-size], cur[size:]), size * 2
    return np.minimum(cur[: len(h) - w + 1], cur[w - size : w - size + len(h) - w + 1]) if w > size else cur[: len(h) - w + 1]


def picked(h: np.ndarray, w: int, owner: np.ndarray) -> np.ndarray:
    """Positions that hold the smallest value of some w consecutive ones with one owner (all equal smallest ones are taken)."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = window_min(h, w)
    whole = owner[: len(low)] == owner[w - 1 :]
    # a position is taken if the largest of the minima over the whole windows that hold it equals its own value
    low = np.where(whole, low, np.uint64(0))
    best = np.zeros(len(h) + w - 1, dtype=np.uint64)
    best[w - 1 : w - 1 + len(low)] = low
    top = ~window_min(~best, w)[: len(h)]
    return np.nonzero((top == h) & (h > 0))[0]


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.nonzero(d == 1)[0], np.nonzero(d == -1)[0]


def ragged(source: np.ndarray, start: np.ndarray, count: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """source[start:start + count] of each row, one after the other; places are worked out for about ``step`` values at a time."""
    upto = np.append(0, np.cumsum(count))
    out, i = np.empty(int(upto[-1]), dtype=source.dtype), 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + step, side="right")) - 1)
        if j == i + 1:
            out[upto[i] : upto[j]] = source[start[i] : start[i] + count[i]]
        else:
            out[upto[i] : upto[j]] = source[np.repeat(start[i:j] - upto[i:j], count[i:j]) + np.arange(upto[i], upto[j])]
        i = j
    return out


def lean(run: Callable) -> Callable:
    """A function of Arrow batches whose worker gives freed memory back to the system when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def binary_array(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data)]).cast(pa.binary())
