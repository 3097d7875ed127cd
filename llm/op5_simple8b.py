"""Token ids in Simple-8b files.

A 64-bit word holds a 4-bit selector and n values of 60 // n bits or so (COUNTS, BITS); selector 0 is an escape:
one value of any size, kept in the block's escape list. A file has blocks of BLOCK_IDS ids, each with
its own offset in the footer, so blocks decode apart and by whole arrays:

    magic "KS8B0001"
    blocks: u64 words, then u64 escapes
    footer: block table (offset, ids, words, escapes: 4 x i64 each), document table (doc_id, row_key, ids: 3 x i64 each)
    i64 number of blocks, i64 number of documents, magic

Files hold documents in ascending id order and follow each other by part number. Null texts are empty documents:
their end id alone. Repeated and null ids stay rows (nulls first).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.workspace import materialise
from llm.common import documents, keyed, lean, text_blocks
from llm.files import new_folder, open_fs, part_name
from llm.tokens import default_path, tokenizer

MAGIC = b"KS8B0001"
BLOCK_IDS = 1 << 16
#: Values in a word, and bits of each, by selector 1 to 14; 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_U = np.uint64


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned values: each word takes as many as fit, greedily."""
    v = ids.astype(_U)
    n = len(v)
    if not n:
        return np.zeros(0, _U), np.zeros(0, _U)
    # the narrowest selector for each value: the place of its size among BITS[1:]
    limit = np.array([1 << int(b) for b in BITS[1:]], dtype=_U)
    need = (np.searchsorted(limit, v, side="right") + 1).astype(np.uint8)  # 15: an escape
    pad = np.concatenate([need, np.ones(60, np.uint8)])
    best = np.zeros(n, dtype=np.uint8)
    step = np.ones(n, dtype=np.uint8)
    widest, size = pad[:n].copy(), 1
    for s in range(14, 0, -1):
        while size < COUNTS[s]:
            np.maximum(widest, pad[size : size + n], out=widest)
            size += 1
        fits = widest <= s
        best[fits], step[fits] = s, COUNTS[s]
    # which positions begin a word: follow the steps
    jump, at, i = step.tolist(), [], 0
    while i < n:
        at.append(i)
        i += jump[i]
    starts = np.array(at, dtype=np.int64)
    sel = best[starts].astype(np.int64)
    words = sel.astype(_U) << _U(60)
    padded = np.concatenate([v, np.zeros(60, _U)])
    for s in np.unique(sel).tolist():
        if s:
            m = np.nonzero(sel == s)[0]
            w = words[m]
            for k in range(int(COUNTS[s])):
                w |= padded[starts[m] + k] << _U(k * int(BITS[s]))
            words[m] = w
    return words, v[starts[sel == 0]]


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    sel = (words >> _U(60)).astype(np.int64)
    counts = COUNTS[sel]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) if len(words) else 0, dtype=_U)
    for s in np.unique(sel).tolist():
        m = np.nonzero(sel == s)[0]
        if s == 0:
            out[place[m]] = escapes
            continue
        mask = _U((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[place[m] + k] = (words[m] >> _U(k * int(BITS[s]))) & mask
    return out[:n]


class Writer:
    def __init__(self, out) -> None:
        self.out, self.at, self.blocks, self.docs, self.held, self.n = out, len(MAGIC), [], [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, row_key: int, ids: np.ndarray) -> None:
        self.docs.append((np.iinfo(np.int64).min if doc_id is None else doc_id, row_key, len(ids)))
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= BLOCK_IDS:
            self._put(False)

    def _put(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(ids) if all_of_it else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, stop, BLOCK_IDS):
            part = ids[i : min(i + BLOCK_IDS, stop)]
            words, escapes = encode_block(part)
            self.out.write(words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes())
            self.blocks.append((self.at, len(part), len(words), len(escapes)))
            self.at += 8 * (len(words) + len(escapes))
        self.held, self.n = ([ids[stop:]], len(ids) - stop) if stop < len(ids) else ([], 0)

    def close(self) -> None:
        self._put(True)
        table = lambda rows, k: np.array(rows, dtype="<i8").reshape(-1, k).tobytes()
        self.out.write(table(self.blocks, 4) + table(self.docs, 3) + table([(len(self.blocks), len(self.docs))], 2) + MAGIC)


def read_tables(f, size: int) -> tuple[np.ndarray, np.ndarray]:
    f.seek(size - 24)
    tail = f.read(24)
    if size < 32 or tail[16:] != MAGIC:
        raise ValueError("not a whole Simple-8b file")
    blocks, docs = np.frombuffer(tail, "<i8", 2).tolist()
    f.seek(size - 24 - 32 * blocks - 24 * docs)
    raw = f.read(32 * blocks + 24 * docs)
    return np.frombuffer(raw, "<i8", 4 * blocks).reshape(-1, 4), np.frombuffer(raw, "<i8", 3 * docs, 32 * blocks).reshape(-1, 3)


def read_blocks(f, blocks: np.ndarray) -> Iterator[np.ndarray]:
    """Ids of each block; any block can be read without the others."""
    for at, n, words, escapes in blocks.tolist():
        f.seek(at)
        raw = np.frombuffer(f.read(8 * (words + escapes)), "<u8")
        yield decode_block(raw[:words], raw[words:], n)


_FILES = "part int, path string, n_docs bigint, n_ids bigint"


def _write(folder: str, tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, path = tokenizer(tokenizer_path), f"{folder}/{part_name('.s8b')}"
        fs, p = open_fs(path)
        end, n_docs, n_ids = np.array([end_id], np.uint32), 0, 0
        with fs.open_output_stream(p) as out:
            w = Writer(out)
            for b in batches:
                doc_ids, keys, i = b.column(0).to_pylist(), b.column(1).to_numpy(), 0
                for ks, data, offs in text_blocks(keys, b.column(2)):
                    for key, ids in zip(ks.tolist(), tok.encode_block(data, offs), strict=True):
                        w.add(doc_ids[i], key, np.append(ids, end))
                        n_docs, n_ids, i = n_docs + 1, n_ids + len(ids) + 1, i + 1
            w.close()
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "path": path, "n_docs": n_docs, "n_ids": n_ids}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return lean(run)


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Write the files; returns their list (part, path, n_docs, n_ids), one row each, itself kept in the shared folder."""
    spark = docs.sparkSession
    k = keyed(docs, id_col, text_col).select("doc_id", "row_key", "text")
    placed = k.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "row_key").sortWithinPartitions("row_key")
    return materialise(placed.mapInArrow(_write(new_folder(spark, "ids"), tokenizer_path, end_id), _FILES))


def with_starts(files: DataFrame) -> DataFrame:
    """Ids before each file. The list has one row a file, and is folded on the driver."""
    rows = sorted((r["part"], r["path"], r["n_ids"]) for r in files.collect())
    before = [0, *accumulate(r[2] for r in rows)]
    return files.sparkSession.createDataFrame([(p, path, b) for (p, path, _), b in zip(rows, before, strict=False)], "part int, path string, before bigint")


_DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.iinfo(np.int64).min
    for batch in batches:
        for row in batch.to_pylist():
            fs, p = open_fs(row["path"])
            with fs.open_input_file(p) as f:
                blocks, docs = read_tables(f, f.size())
                crcs, k, left, crc = [], 0, int(docs[0, 2]) if len(docs) else 0, 0
                for ids in read_blocks(f, blocks):
                    raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                    while k < len(docs) and at < len(ids):
                        take = min(left, len(ids) - at)
                        crc = zlib.crc32(raw[4 * at : 4 * (at + take)], crc)
                        at, left = at + take, left - take
                        if not left:
                            crcs.append(crc)
                            k, crc = k + 1, 0
                            left = int(docs[k, 2]) if k < len(docs) else 0
            n = docs[:, 2]
            start = row["before"] + np.cumsum(n) - n
            doc_id = pa.array(docs[:, 0], pa.int64(), mask=docs[:, 0] == none)
            for i in range(0, len(docs), 20_000):
                j = i + 20_000
                yield pa.RecordBatch.from_arrays([doc_id[i:j], pa.array(start[i:j]), pa.array(n[i:j].copy()), pa.array(crcs[i:j], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    f = with_starts(files)
    n = max(1, min(f.count(), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return f.repartition(n).mapInArrow(_read, _DOCS)


def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(documents(spark, sf_dir), default_path(), 2))
