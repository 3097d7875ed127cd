"""Suffix-array dedup of byte strings.

A string of LENGTH bytes belongs to the smallest of its GRAM-byte hashes; consecutive strings with one smallest hash are a run, and
the bytes that a run's strings cover are its context. Equal strings have equal smallest hashes, so a hash that only one
run has, and has once, rules its strings out (exchange 1; a run that may hold it twice, as in a period, counts as two). The contexts of the others meet by hash (exchange 2), and there
the suffix array of the contexts, built by difference cover (sort sampled triples, recurse on their names, place the remaining
suffixes by one symbol and a rank, merge), brings equal strings together: neighbours are compared over LENGTH bytes, and of each
group all but the string with the smallest document and start are removed.

So only text that may repeat is suffix-sorted, and it is sorted in pieces that belong together, of at most PIECE symbols: a
global suffix order of the whole corpus is neither needed nor built (it would shuffle several rows for each byte).
Equal contexts, compared by their bytes, are merged before the exchange and after it, so copies, however many, reach a
suffix array once. A hash that is then left with one context, with its gram once in it, repeats nothing more and is not sorted. A hash with
more context than a piece is dealt to pieces by a hash of each string; a piece keeps the first of each string and goes
on with more until all have passed (``later_in_pieces``), so one string may occur any number of times.

Runs are cut at RUN strings and long texts at blocks, so long runs of one byte and very long texts take memory in proportion to their length.

Edge cases: null and empty texts have no bytes; texts under LENGTH bytes lose nothing; rows with one id are ordered by their text,
and rows without an id come first (see ``keyed``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from llm.common import BLOCK_BYTES, documents, gram_hashes, keyed, lean, mix, picked, ragged, squeezed, text_blocks, unsqueeze, window_min
from llm.exchange import BLOB, Sender, _row_bucket, _squeeze, bucket_count, repeated
from llm.suffixes import equal_neighbours, suffix_array

LENGTH, GRAM = 100, 32
#: Strings in a run at most (they are counted in one byte), symbols of a suffix array, bytes of contexts that a task merges before it sends them.
RUN, PIECE, HOLD_BYTES = 255, 1 << 18, 16 << 20
_U = np.uint64
CONTEXTS = "bucket int, n bigint, h binary, who binary, body binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("h", pa.binary()), ("who", pa.binary()), ("body", pa.binary())])


def _blocks(keys: np.ndarray, texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(keys, bytes, offsets, first): blocks of whole texts, or a stretch from byte ``first`` on of one very long text, with the bytes that its last strings need."""
    for k, data, offs in text_blocks(keys, texts):
        if len(k) > 1 or len(data) <= BLOCK_BYTES + length:
            yield k, data, offs, 0
            continue
        for a in range(0, len(data) - length + 1, BLOCK_BYTES):
            part = data[a : a + BLOCK_BYTES + length - 1]
            yield k, part, np.array([0, len(part)]), a


def runs(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(smallest hash, first string's start, strings, text) of the runs of a block; a run that may hold its hash twice comes twice."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3))
    hashes = gram_hashes(data.astype(_U), gram) | _U(1)
    low = window_min(hashes, length - gram + 1)
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    whole = np.diff(offs) >= length
    np.add.at(inside, offs[:-1][whole], 1)
    np.add.at(inside, offs[1:][whole] - length + 1, -1)
    at = np.nonzero(np.cumsum(inside[:n]) > 0)[0]
    if not len(at):
        return np.zeros(0, _U), at, at, at
    value = low[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1])
    # texts that stand side by side in the block and both hold strings are apart already: a text's last start is not the byte before the next
    head = np.nonzero(new)[0]
    size = np.diff(np.append(head, len(at)))
    cuts = -(-size // RUN)
    nth = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    start = at[np.repeat(head, cuts)] + nth * RUN
    count = np.minimum(np.repeat(size, cuts) - nth * RUN, RUN)
    # places of one hash in one run are neighbours among the places of smallest hashes: between them, no string is without it
    place = picked(hashes, length - gram + 1, np.zeros(len(hashes), np.int8))
    again = place[:-1][hashes[place[1:]] == hashes[place[:-1]]]
    twice = np.searchsorted(again, start + count - 1 + length - gram) > np.searchsorted(again, start)
    k = np.repeat(np.arange(len(start)), 1 + twice)
    return value[np.repeat(head, cuts)][k], start[k], count[k], np.searchsorted(offs, start[k], side="right") - 1


def _anchors(length: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(buckets, False)
        for b in batches:
            for keys, data, offs, first in _blocks(b.column(0).to_numpy(), b.column(1), length):
                g, start, count, own = runs(data, offs, length, gram)
                if len(g):
                    yield from out.add(g, mix(g) >> _U(32), keys[own], (start - offs[own] + first) << 8 | count)
        yield from out.flush()

    return lean(run)


def _emit(bucket: np.ndarray, g: np.ndarray, key: np.ndarray, at: np.ndarray, n: np.ndarray, body: np.ndarray | None, starts: np.ndarray | None, size: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """One row a bucket; without a body, runs that are known to go."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.nonzero(np.diff(bucket[order]))[0] + 1, [len(order)]])
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        o = order[i:j]
        who = _squeeze(np.diff(key[o].astype(np.int64), prepend=0), at[o].astype(np.int32), n[o].astype(np.int32))
        text = _squeeze(ragged(body, starts[o], size[o])) if body is not None else b""
        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((int(bucket[o[0]]), len(o), g[o].astype(_U).tobytes() if body is not None else b"", who, text), _SCHEMA, strict=True)], schema=_SCHEMA)


def _chunks(size: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Contexts i:j of about ``limit`` bytes together."""
    ends, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + limit, side="right")))
        yield i, j
        i = j


def _digests(body: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A digest of each context: sums of hashes of its bytes and their places. It only orders contexts: equal ones are told by their bytes."""
    out = np.zeros(len(size), _U)
    for i, j in _chunks(size):
        first = np.cumsum(size[i:j]) - size[i:j]
        place = np.arange(int(size[i:j].sum())) - np.repeat(first, size[i:j])
        out[i:j] = np.add.reduceat(mix((ragged(body, starts[i:j], size[i:j]).astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15) + place.astype(_U) * _U(0xD6E8FEB86659FD93)), first)
    return out


def _merged(g: np.ndarray, key: np.ndarray, at: np.ndarray, n: np.ndarray, body: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, known): of contexts with one hash and the same bytes, the first in order of rows stands for all, the others are known to go."""
    size = n + length - 1
    digest = _digests(body, starts, size)
    order = np.lexsort((at, key, digest, n, g))
    a, b = order[:-1], order[1:]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (g[b] == g[a]) & (n[b] == n[a]) & (digest[b] == digest[a])
    k = np.nonzero(same)[0]
    for i, j in _chunks(size[order[k]]):
        x, y = order[k[i:j] - 1], order[k[i:j]]
        differ = ragged(body, starts[x], size[x]) != ragged(body, starts[y], size[y])
        if differ.any():
            same[k[i:j][np.unique(np.repeat(np.arange(j - i), size[x])[differ])]] = False
    return np.sort(order[~same]), np.sort(order[same])


def _alone(g: np.ndarray, n: np.ndarray, starts: np.ndarray, body: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Contexts that are the only one of their hash, and hold its gram once.

    Equal strings of a context have the gram at the same place of each, so twice in the context: these contexts repeat nothing.
    """
    _, inverse, counts = np.unique(g, return_inverse=True, return_counts=True)
    single = np.nonzero(counts[inverse] == 1)[0]
    size, out = n[single] + length - 1, np.zeros(len(g), dtype=bool)
    for i, j in _chunks(size):
        at = gram_hashes(ragged(body, starts[single[i:j]], size[i:j]).astype(_U), gram) | _U(1)
        own = np.repeat(np.arange(j - i), size[i:j])
        hit = (own[: len(at)] == own[gram - 1 :]) & (at == g[single[i:j]][own[: len(at)]])
        out[single[i:j]] = np.bincount(own[: len(at)][hit], minlength=j - i) == 1
    return out


def _smallest(data: np.ndarray, start: np.ndarray, length: int, gram: int, step: int = 2048) -> np.ndarray:
    """The smallest hash of each string."""
    out = np.zeros(len(start), _U)
    for i in range(0, len(start), step):
        rows = data[start[i : i + step, None] + np.arange(length)]
        g = np.append(gram_hashes(rows.ravel().astype(_U), gram) | _U(1), np.zeros(gram - 1, _U)).reshape(rows.shape)
        out[i : i + step] = g[:, : length - gram + 1].min(axis=1)
    return out


def _contexts(length: int, gram: int, buckets: int):
    """Contexts of the repeated hashes: key, first string start, number of strings, bytes."""

    def send(held: list) -> Iterator[pa.RecordBatch]:
        g, key, at, n = (np.concatenate([x[k] for x in held]) for k in range(4))
        body = np.concatenate([x[4] for x in held])
        size = n + length - 1
        starts = np.cumsum(size) - size
        first, known = _merged(g, key, at, n, body, starts, length)
        yield from _emit((g[first] % _U(buckets)).astype(np.int64), g[first], key[first], at[first], n[first], body, starts[first], size[first])
        if len(known):
            yield from _emit(_row_bucket(key[known], buckets), g[known], key[known], at[known], n[known], None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            lists = batch.column(2)
            loffs, lvals, place = lists.offsets.to_numpy(), lists.values.to_numpy(), 0
            for keys, data, offs in text_blocks(batch.column(0).to_numpy(), unsqueeze(batch.column(1))):
                counts = np.diff(loffs[place : place + len(keys) + 1])
                mine = lvals[loffs[place] : loffs[place + len(keys)]]
                own = np.repeat(np.arange(len(keys)), counts)
                place += len(keys)
                if not len(mine):
                    continue
                at, n = mine >> 8, mine & 255
                for i, j in _chunks(n + length - 1, HOLD_BYTES // 4):
                    start, size = offs[own[i:j]] + at[i:j], n[i:j] + length - 1
                    # the hash of a run is that of its first string
                    g = _smallest(data, start, length, gram)
                    held.append((g, keys[own[i:j]], at[i:j], n[i:j], ragged(data, start, size)))
                    weight += int(size.sum())
                    if weight >= HOLD_BYTES:
                        yield from send(held)
                        held, weight = [], 0
        if held:
            yield from send(held)

    return lean(run)


def equal_strings(body: np.ndarray, starts: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(later, first): of the n[k] strings from starts[k] on, numbered in a row, those that equal one before them, and the others, by suffix array."""
    size = n + length - 1
    # each context ends in a symbol below every byte, so that no string runs on
    first = np.cumsum(size + 1) - (size + 1)
    inside = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    text = np.zeros(int((size + 1).sum()), dtype=np.uint8)
    text[inside] = ragged(body, starts, size)
    t = np.ones(len(text), dtype=np.int64)
    t[inside] = text[inside].astype(np.int64) + 2
    number = np.full(len(text), -1, dtype=np.int64)
    number[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = np.arange(int(n.sum()))
    order = suffix_array(t)
    order = order[number[order] >= 0]
    head = np.nonzero(~equal_neighbours(text, order, length))[0]
    number = number[order]
    lead = np.minimum.reduceat(number, head)
    return number[number != np.repeat(lead, np.diff(np.append(head, len(order))))], lead


def later_in_pieces(body: np.ndarray, at: np.ndarray, length: int, salt: int = 0) -> Iterator[np.ndarray]:
    """Which of the strings at ``at`` (in order of rows and starts) equal one before them, looked at a piece at a time.

    Strings are parted by a hash, equal ones together. A part passes through pieces: what a piece has found to be the first of its kind goes
    on into the next, until all strings have passed. A part with too many different strings is parted again.
    """
    room = max(2, PIECE // (length + 1))
    if len(at) <= room:
        if len(at):
            yield equal_strings(body, at, np.ones(len(at), np.int64), length)[0]
        return
    h = np.full(len(at), salt, dtype=_U)
    for i in range(length):
        h = h * _U(0x100000001B3) + body[at + i].astype(_U)
    parts = 2 * -(-len(at) // room)
    part = (mix(h + _U(salt)) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for mine in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1):
        kept, i = mine[:0], 0
        while i < len(mine):
            if len(kept) > room // 2 and salt < 8:
                left = np.sort(np.concatenate([kept, mine[i:]]))
                for x in later_in_pieces(body, at[left], length, salt + 1):
                    yield left[x]
                break
            take = np.sort(np.concatenate([kept, mine[i : i + max(room - len(kept), room // 2)]]))
            i += max(room - len(kept), room // 2)
            later, first = equal_strings(body, at[take], np.ones(len(take), np.int64), length)
            if len(later):
                yield take[later]
            kept = take[first]


def later_strings(key: np.ndarray, at: np.ndarray, n: np.ndarray, starts: np.ndarray, body: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, start) of the strings of the contexts of one piece, or of one hash, that are not the first of their kind."""
    o = np.lexsort((at, key))
    key, at, n, starts = key[o], at[o], n[o], starts[o]
    upto = np.cumsum(n)
    if int((n + length).sum()) <= PIECE:
        found = iter([equal_strings(body, starts, n, length)[0]])
    else:
        found = later_in_pieces(body, np.repeat(starts - (upto - n), n) + np.arange(int(upto[-1])), length)
    for x in found:
        k = np.searchsorted(upto, x, side="right")
        yield key[k], at[k] + x - (upto - n)[k]


def _pieces(g: np.ndarray, size: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Contexts in order of their hash, cut between hashes into pieces of at most ``limit`` bytes; a hash with more is a piece by itself."""
    order = np.argsort(g, kind="stable")
    total = 0
    heads = np.concatenate([[0], np.nonzero(np.diff(g[order]))[0] + 1, [len(order)]])
    upto = np.append(0, np.cumsum(size[order] + 1))
    start = 0
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        w = int(upto[b] - upto[a])
        if total and total + w > limit:
            yield order[start:a]
            start, total = a, 0
        total += w
    if start < len(order):
        yield order[start:]


def _runs_of_starts(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    o = np.lexsort((at, key))
    key, at = key[o], at[o]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] > at[:-1] + 1)
    f = np.nonzero(new)[0]
    last = np.append(f[1:], len(key)) - 1
    return key[f], at[f], at[last] - at[f] + 1


def _resolve(length: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = [], []
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for _, n, h, who, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = d.decompress(who)
                key, at, count = np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.int32, n, 8 * n).astype(np.int64), np.frombuffer(raw, np.int32, n, 12 * n).astype(np.int64)
                if h:
                    held.append((np.frombuffer(h, _U, n), key, at, count, np.frombuffer(d.decompress(text), np.uint8)))
                else:
                    known.append((key, at, count))
        if held:
            g, key, at, n, body = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size = n + length - 1
            starts = np.cumsum(size) - size
            first, more = _merged(g, key, at, n, body, starts, length)  # of different flushes
            known.append((key[more], at[more], n[more]))
            left = first[~_alone(g[first], n[first], starts[first], body, length, gram)]
            for p in _pieces(g[left], size[left], PIECE):
                p = left[p]
                known += [_runs_of_starts(*x) for x in later_strings(key[p], at[p], n[p], starts[p], body, length) if len(x[0])]
        if known:
            key, at, n = (np.concatenate(x) for x in zip(*known, strict=True))
            o = np.lexsort((at, key))
            yield from _emit(_row_bucket(key[o], buckets), key[o], key[o], at[o], n[o], None, None, None)

    return lean(run)


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, at, n): runs of removed string starts."""
    held, d = [], zstandard.ZstdDecompressor()
    for batch in batches:
        for n, who in zip(batch.column("n").to_pylist(), batch.column("who").to_pylist(), strict=True):
            raw = d.decompress(who)
            held.append((np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.int32, n, 8 * n), np.frombuffer(raw, np.int32, n, 12 * n)))
    if not held:
        return
    key, at, n = (np.concatenate(x) for x in zip(*held, strict=True))
    o = np.lexsort((at, key))
    key, at, n = key[o], at[o], n[o]
    first = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1])
    ends = np.append(first[1:], len(key))
    for i in range(0, len(first), 512):
        f, e = first[i : i + 512], ends[i : i + 512]
        offs = pa.array(np.append(f, e[-1]) - f[0], pa.int32())
        lists = [pa.ListArray.from_arrays(offs, pa.array(x[f[0] : e[-1]])) for x in (at, n)]
        yield pa.RecordBatch.from_arrays([pa.array(key[f]), *lists], names=["row_key", "at", "n"])


def later_runs(keyed_docs: DataFrame, z: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row_key, at, n): n consecutive starts from ``at`` on, of strings that also start earlier; z are the compressed texts."""
    buckets = bucket_count(keyed_docs)
    text = keyed_docs.select("row_key", "text")
    hit = repeated(text.mapInArrow(_anchors(length, gram, buckets), BLOB), buckets)
    near = z.join(hit, "row_key").select("row_key", "z", "at", "doc_id")
    met = near.mapInArrow(_contexts(length, gram, buckets), CONTEXTS).repartition(buckets, "bucket")
    return met.mapInArrow(_resolve(length, gram, buckets), CONTEXTS).repartition(buckets, "bucket").mapInArrow(_by_row, "row_key bigint, at array<int>, n array<int>")


_OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, texts = [], unsqueeze(b.column(1))
            for i in range(b.num_rows):
                t = texts[i]
                body = t.as_buffer().to_pybytes() if t.is_valid else b""
                spans: list[list[int]] = []
                if b.column(2)[i].is_valid:
                    for a, n in zip(b.column(2)[i].as_py(), b.column(3)[i].as_py(), strict=True):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], a + n + length - 1)
                        else:
                            spans.append([a, a + n + length - 1])
                h, at = hashlib.sha256(), 0
                for a, z in spans:
                    h.update(body[at:a])
                    at = z
                h.update(body[at:])
                out.append((len(body), sum(z - a for a, z in spans), len(spans), h.hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(cols))], names=[x.split()[0] for x in _OUT.split(", ")])

    return lean(run)


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    k = keyed(docs, id_col, text_col)
    # one exchange of the texts for both joins: they are merge joins on the same rows and columns
    z = squeezed(k).filter("row_key is not null").hint("merge")
    return z.join(later_runs(k, z, length, gram), "row_key", "left").select("doc_id", "z", "at", "n").mapInArrow(_strip(length), _OUT)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir))
