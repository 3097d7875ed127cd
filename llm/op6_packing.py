"""Hierarchical packing of documents into sequences of several lengths.

Tiers are the powers of two from ``max_len`` down to ``min_len``. A document gives as many full windows of the longest tier
as it holds; what is left over is routed, by its length, to the tier of the largest power of two that it fills, and packs
there: a tier's open sequence takes pieces until it is full, the piece that crosses the end being cut. When input ends, open
sequences of longer tiers are filled from those of shorter tiers, and what still is short closes at powers of two, longest
first, so nothing is padded. Tasks pack by themselves: no shuffle, and memory for
one open sequence a tier, whatever the input.

Each sequence has a step group; groups of a tier are dealt so that each holds the same number of tokens (sequences of one
tier are equally long): position in its task's tier modulo ``groups``, from a start that moves on by one from task to task and
from length to length, so lengths of which a task closes few are dealt too.

Null and empty texts are their end id alone. Ids need not be unique: every row is packed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents, lean, text_blocks
from llm.tokens import default_path, tokenizer

MAX_LEN, MIN_LEN, GROUPS = 2048, 64, 8
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint, step_group int"


class Packer:
    """Pieces are (doc, start, ids, doc_tokens); closed sequences come out as lists of (piece, offset) with their length."""

    def __init__(self, max_len: int = MAX_LEN, min_len: int = MIN_LEN) -> None:
        if max_len < min_len or any(x < 1 or x & (x - 1) for x in (max_len, min_len)):
            raise ValueError("lengths must be powers of two")
        self.tiers = [max_len]
        while self.tiers[-1] > min_len:
            self.tiers.append(self.tiers[-1] // 2)
        self.open: dict[int, list] = {t: [] for t in self.tiers}
        self.fill = dict.fromkeys(self.tiers, 0)

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple[int, list]]:
        top, n = self.tiers[0], len(ids)
        full = n // top * top
        for i in range(0, full, top):
            yield top, [(doc, i, ids[i : i + top], n)]
        if full < n:
            rest = n - full
            tier = next((t for t in self.tiers if t <= rest), self.tiers[-1])
            yield from self._place(tier, (doc, full, ids[full:], n))

    def _place(self, tier: int, piece) -> Iterator[tuple[int, list]]:
        doc, start, ids, n = piece
        while len(ids):
            take = min(len(ids), tier - self.fill[tier])
            self.open[tier].append((doc, start, ids[:take], n))
            self.fill[tier] += take
            start, ids = start + take, ids[take:]
            if self.fill[tier] == tier:
                done, self.open[tier], self.fill[tier] = self.open[tier], [], 0
                yield tier, done

    def close(self) -> Iterator[tuple[int, list]]:
        """Open sequences of shorter tiers fill the gaps of longer ones; the last rest closes at powers of two."""
        rest = []
        for t in self.tiers:
            rest += self.open[t]
            self.open[t], self.fill[t] = [], 0
        left = sum(len(p[2]) for p in rest)
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            seq, have = [], 0
            while rest and have < size:
                doc, start, ids, n = rest.pop(0)
                take = min(len(ids), size - have)
                seq.append((doc, start, ids[:take], n))
                have += take
                if take < len(ids):
                    rest.insert(0, (doc, start + take, ids[take:], n))
            left -= have
            yield size, seq


def _pack(tokenizer_path: str, end_id: int, max_len: int, min_len: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, packer, part = tokenizer(tokenizer_path), Packer(max_len, min_len), TaskContext.get().partitionId()
        names = [c.split()[0] for c in PIECES.split(", ")]
        state = {"seq": part << 40, "rows": [], "of": {}}

        def put(closed) -> None:
            for size, pieces in closed:
                at = 0
                k = state["of"][size] = state["of"].get(size, part + size.bit_length() - 1) + 1
                for doc, start, ids, n in pieces:
                    state["rows"].append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, state["seq"], at, size, k % groups))
                    at += len(ids)
                state["seq"] += 1

        def out() -> pa.RecordBatch:
            cols, state["rows"] = list(zip(*state["rows"], strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if x == "step_group" else pa.int64()) for c, x in zip(cols, names, strict=True)], names=names)

        for b in batches:
            docs, i = b.column(0).to_pylist(), 0
            for ks, data, offs in text_blocks(np.arange(b.num_rows), b.column(1)):
                for ids in tok.encode_block(data, offs):
                    put(packer.add(docs[i], np.append(ids, np.uint32(end_id))))
                    i += 1
                if len(state["rows"]) > 20_000:
                    yield out()
        put(packer.close())
        if state["rows"]:
            yield out()

    return lean(run)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_len: int = MAX_LEN, min_len: int = MIN_LEN, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.mapInArrow(_pack(tokenizer_path, end_id, max_len, min_len, groups), PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_path())
