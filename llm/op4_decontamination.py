"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every run of SEED words of a test item is a seed, and every seed is used, however many documents hold it: a text that shares
one is aligned with the item, word by word (match +2, mismatch -1, gap -1), around each diagonal. The score is the best local
alignment over that of the whole item; a document is contaminated by an item from THRESHOLD on, so paraphrased or edited copies
that keep a seed are found and short common phrases are not. A stretch with too few words of the item for that
score is not aligned (``can_reach``), so phrases that are common besides cost little.

Items are joined to passages in blocks: one block's seeds and words are sent to every executor, and a block holds at most
BLOCK_WORDS words, so what is broadcast has a fixed bound; more items mean more blocks, each against all rows.

Edge cases: null and empty texts and items match nothing; items of fewer words than a seed use their whole word run as the seed;
repeated items and documents are rows of their own; null ids are reported as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.workspace import materialise
from llm.common import documents, gram_hashes, lean, numbered, span_hashes, text_blocks, word_spans

SEED, THRESHOLD, BLOCK_WORDS = 4, 0.5, 1 << 19
MATCH, MISS, GAP = 2, -1, -1
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
#: Marks that do not tell words apart: they count as white space.
_TABLE[list(b".,;:!?\"'()[]{}*#$%&|")] = 32


def plain(data: np.ndarray) -> np.ndarray:
    """Lower case without punctuation, byte for byte."""
    return _TABLE[data]


def text_words(text: str) -> np.ndarray:
    data = plain(np.frombuffer(text.encode(), dtype=np.uint8))
    a, b, _ = word_spans(data, np.array([0, len(data)]))
    return span_hashes(data, a, b)


class Items:
    """Words and seeds of a block of items."""

    def __init__(self, rows: list[tuple[int | None, str]], seed: int) -> None:
        self.ids = [r[0] for r in rows]
        self.words = [text_words(r[1] or "") for r in rows]
        h, item, at = [], [], []
        for i, w in enumerate(self.words):
            g = gram_hashes(w, min(seed, len(w))) if len(w) else np.zeros(0, np.uint64)
            if len(w) >= seed:
                h.append(g)
                item += [i] * len(g)
                at += range(len(g))
        self.short = [i for i, w in enumerate(self.words) if 0 < len(w) < seed]
        hh = np.concatenate(h) if h else np.zeros(0, np.uint64)
        o = np.argsort(hh, kind="stable")
        self.h, self.item, self.at = hh[o], np.array(item, dtype=np.int64)[o], np.array(at, dtype=np.int64)[o]
        self.uniq = np.unique(self.h)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (best score, start and end in the passage), by anti-diagonals."""
    m, n = len(item), len(passage)
    if not m or not n:
        return 0, 0, 0
    # a diagonal d holds the cells (i, d - i), by i; begin has where in the passage a cell's alignment starts
    zero = np.zeros(m + 1, dtype=np.int64)
    one, two = zero, zero
    b_one, b_two = zero, zero
    best, span = 0, (0, 0)
    for d in range(2, m + n + 1):
        lo, hi = max(1, d - n), min(m, d - 1)
        i = np.arange(lo, hi + 1)
        j = d - i
        s = np.where(item[i - 1] == passage[j - 1], MATCH, MISS)
        diag, up, left = two[i - 1] + s, one[i - 1] + GAP, one[i] + GAP
        v = np.maximum(np.maximum(diag, 0), np.maximum(up, left))
        fresh = two[i - 1] == 0
        b = np.where(diag >= np.maximum(up, left), np.where(fresh, j - 1, b_two[i - 1]), np.where(up >= left, b_one[i - 1], b_one[i]))
        cur, b_cur = np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
        cur[i], b_cur[i] = v, b
        k = int(np.argmax(v))
        if v[k] > best:
            best, span = int(v[k]), (int(b[k]), int(j[k]))
        two, one, b_two, b_one = one, cur, b_one, b_cur
    return best, *span


def can_reach(item: np.ndarray, passage: np.ndarray, least: float) -> bool:
    """False only if no alignment scores ``least``: it matches no more words than either side has of the other."""
    return MATCH * min(np.isin(item, passage).sum(), np.isin(passage, item).sum()) >= least - 1e-9


def _seed_hits(items: Items, seed: int, data: np.ndarray, offs: np.ndarray):
    """(word starts, first, names, positions of seed hits): every place where a seed of the block stands within one text."""
    low = plain(data)
    starts, ends, first = word_spans(low, offs)
    names = span_hashes(low, starts, ends)
    g = gram_hashes(names, seed)
    k = np.searchsorted(items.uniq, g)
    hit = np.nonzero(items.uniq[np.minimum(k, len(items.uniq) - 1)] == g)[0] if len(items.uniq) and len(g) else np.zeros(0, np.int64)
    owner = np.searchsorted(first, hit, side="right") - 1
    ok = hit + seed <= first[owner + 1] if len(hit) else np.zeros(0, bool)
    return first, names, g, hit[ok], owner[ok]


_OUT = "doc_row bigint, doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint, n_seeds bigint"


def _match(rows: list, seed: int, threshold: float):
    names_out = [x.split()[0] for x in _OUT.split(", ")]

    def spans(items: Items, item: int, diag: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Stretches of a text to align with an item: around seeds, merged where they meet."""
        size = len(items.words[item])
        lo = np.maximum(np.sort(diag) - size // 2, 0)
        hi = np.minimum(np.sort(diag) + size + size // 2, n)
        a, b = int(lo[0]), int(hi[0])
        for x, y in zip(lo[1:].tolist(), hi[1:].tolist(), strict=True):
            if x > b or b - a > 8 * size:  # long merged stretches are cut, with an item's length of overlap
                yield a, b
                a = max(x, a)
            b = max(b, y)
        yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, seed)
        for b in batches:
            ids, out, base = b.column(0).to_pylist(), [], 0
            for _, data, offs in text_blocks(np.arange(b.num_rows), b.column(1)):
                first, names, g, hit, owner = _seed_hits(items, seed, data, offs)
                a, z = np.searchsorted(items.h, g[hit], side="left"), np.searchsorted(items.h, g[hit], side="right")
                found: dict[tuple[int, int], set[int]] = {}
                for p, o, i, j in zip(hit.tolist(), owner.tolist(), a.tolist(), z.tolist(), strict=True):
                    for s in range(i, j):
                        found.setdefault((o, int(items.item[s])), set()).add(p - int(first[o]) - int(items.at[s]))
                for (o, i), diag in found.items():
                    text, w = names[first[o] : first[o + 1]], items.words[i]
                    least = threshold * MATCH * len(w)
                    likely = [(x, y) for x, y in spans(items, i, np.array(list(diag)), len(text)) if can_reach(w, text[x:y], least)]
                    best = max((align(w, text[x:y]) + (x,) for x, y in likely), key=lambda t: t[0], default=(0, 0, 0, 0))
                    score = best[0] / (MATCH * len(w))
                    if score >= threshold:
                        out.append((None, ids[base + o], items.ids[i], score, best[3] + best[1], best[3] + best[2] - 1, len(diag)))
                for i in items.short:  # items shorter than a seed: their words in a row, at the first place in each text
                    w = items.words[i]
                    p = np.nonzero(gram_hashes(names, len(w)) == gram_hashes(w, len(w))[0])[0]
                    o = np.searchsorted(first, p, side="right") - 1
                    inside = p + len(w) <= first[o + 1]
                    texts, at, count = np.unique(o[inside], return_index=True, return_counts=True)
                    for t, q, n in zip(texts.tolist(), (p[inside][at] - first[texts]).tolist(), count.tolist(), strict=True):
                        out.append((None, ids[base + t], items.ids[i], 1.0, q, q + len(w) - 1, n))
                base += len(offs) - 1
            if out:
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names_out)

    return lean(run)


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of at most BLOCK_WORDS words, read from the table one block at a time."""
    block, n = [], 0
    for r in items.select(F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).toLocalIterator():
        size = len(r["t"].split())
        if block and n + size > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append((r["i"], r["t"]))
        n += size
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, n_seeds): the best alignment of each contaminated document and item."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = None
    for rows in _item_blocks(items, item_col, item_text):
        part = d.mapInArrow(_match(rows, seed, threshold), _OUT).drop("doc_row")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], _OUT).drop("doc_row")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their columns; rows with one id or without an id are decided one by one."""
    d = numbered(docs, "_row")
    bad = materialise(matches(d, items, threshold, id_col="_row").select(F.col("doc_id").alias("_row")).distinct())
    return d.join(bad, "_row", "left_anti").select(docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
