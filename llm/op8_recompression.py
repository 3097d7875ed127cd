"""Substring dedup by recompression.

Words get 64-bit names. A round replaces runs of one name by one symbol, and then pairs of
neighbours that a hash of their names puts left and right, under names that depend on their
content alone; so equal stretches get equal symbols all over but for some words at either end.

1. Low symbols, of at most MAX_WORDS words: every window holds a known number of whole common
   ones, and groups of those are named over all documents by an exchange. A group that occurs once
   rules out the windows around it.
2. High symbols: in the documents that are left, rounds go on until nothing merges below TOP
   windows. Each symbol of a window's length or more, at every height, is named by a digest of its
   words, and an exchange tells which names are shared. All words of a shared symbol repeat.
3. What a shared symbol does not settle is verified window by window, under two independent hashes
   of the words (96 bits). Windows inside a symbol that is shared and not the first of its name are
   not sent: the first one's are, or those of a still earlier place, so every different window that may
   repeat is sent from its first place at least.

Texts are exchanged once for all three rounds and the removal.

Edge cases: null and empty texts have no words; repeated ids and null ids are kept apart (see
``keyed``); a window must lie in one document; documents shorter than a window lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from llm.common import documents, gram_hashes, keyed, lean, mix, pair_names, picked, span_hashes, squeezed, text_blocks, unsqueeze, word_spans
from llm.exchange import BLOB, Sender, bucket_count, repeated

WINDOW = 35
MAX_WORDS = 3
ROUNDS = 2
EDGE = 2 + 2 * ROUNDS  # words at either end that may be grouped with what stands outside: 2 by runs of two, 2 by each pair round
TOP = 32  # high symbols hold at most so many windows' words
_SIZE = 16  # bits for a symbol's size beside its place
_U = np.uint64


def _merge(names: np.ndarray, at: np.ndarray, size: np.ndarray, owner: np.ndarray, head: np.ndarray, name: np.ndarray, absorbed: np.ndarray, new_size: np.ndarray):
    names, size = names.copy(), size.copy()
    names[head], size[head] = name, new_size
    keep = ~absorbed
    return names[keep], at[keep], size[keep], owner[keep]


def _runs(names: np.ndarray, at: np.ndarray, size: np.ndarray, owner: np.ndarray, cap: int):
    """Runs of one name that make at most cap words become one symbol; longer ones stay as they are."""
    same = np.zeros(len(names), dtype=bool)
    same[1:] = (names[1:] == names[:-1]) & (owner[1:] == owner[:-1])
    first = np.nonzero(~same)[0]
    length = np.diff(np.append(first, len(names)))
    short = (length >= 2) & (length * size[first] <= cap)
    if not short.any():
        return names, at, size, owner
    absorbed = same & np.repeat(short, length)
    h = first[short]
    return _merge(names, at, size, owner, h, mix(names[h] + length[short].astype(_U) * _U(0xA24BAED4963EE407)), absorbed, length[short] * size[h])


def _pairs(names: np.ndarray, at: np.ndarray, size: np.ndarray, owner: np.ndarray, cap: int, salt: int):
    """Left and right neighbours of at most cap words together become one symbol."""
    right = (mix(names + _U(0x9FB21C651E98DF25 + salt)) >> _U(63)).astype(bool)
    pair = np.zeros(len(names), dtype=bool)
    pair[:-1] = ~right[:-1] & right[1:] & (owner[:-1] == owner[1:]) & (size[:-1] + size[1:] <= cap)
    h = np.nonzero(pair)[0]
    if not len(h):
        return names, at, size, owner
    absorbed = np.zeros(len(names), dtype=bool)
    absorbed[h + 1] = True
    return _merge(names, at, size, owner, h, pair_names(names[h], names[h + 1]), absorbed, size[h] + size[h + 1])


def symbols(words: np.ndarray, owner: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, first word, words, owner) of the low symbols: a round of runs of two, then rounds of pairs."""
    state = words, np.arange(len(words)), np.ones(len(words), dtype=np.int64), owner
    if not len(words):
        return state
    state = _runs(*state, MAX_WORDS - 1)
    for r in range(rounds):
        state = _pairs(*state, MAX_WORDS, r)
    return state


def high_symbols(low: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], least: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of all symbols of ``least`` to ``cap`` words that further rounds make, at every height."""
    state, found, still, salt = low, [], 0, ROUNDS
    while still < 4 and len(state[0]):  # a round may find no pair by its hash alone
        before = len(state[0])
        for grown in (_runs(*state, cap), None):
            grown = grown or _pairs(*state, cap, salt)
            if len(grown[0]) < len(state[0]):
                at, size = grown[1], grown[2]
                fresh = size != state[2][np.searchsorted(state[1], at)]
                big = fresh & (size >= least)
                found.append((at[big], size[big]))
            state = grown
        salt += 1
        still = still + 1 if len(state[0]) == before else 0
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def anchor_plan(window: int) -> tuple[int, int]:
    """(symbols in an anchor, anchors to choose from): what each window is sure to hold."""
    sure = -(-(window - 2 * EDGE) // MAX_WORDS) if window > 2 * EDGE else 0
    if sure < 1:
        raise ValueError(f"a window needs more than {2 * EDGE} words")
    gram = min(15 // MAX_WORDS, max(1, sure // 2))  # a group's words are told in four bits
    return gram, sure - gram + 1


def _words(keys: np.ndarray, data: np.ndarray, offs: np.ndarray, window: int):
    """(keys, first, word names, spans) of the texts that hold a window."""
    starts, ends, first = word_spans(data, offs)
    n = np.diff(first)
    long = n >= window
    take = np.repeat(long, n)
    starts, ends = starts[take], ends[take]
    n = n[long]
    return keys[long], np.concatenate([[0], np.cumsum(n)]), starts, ends


def _anchors(window: int, buckets: int):
    gram, choose = anchor_plan(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(buckets, False)
        for batch in batches:
            for keys, data, offs in text_blocks(batch.column(0).to_numpy(), batch.column(1)):
                keys, first, starts, ends = _words(keys, data, offs, window)
                if not len(keys):
                    continue
                owner = np.repeat(np.arange(len(keys)), np.diff(first))
                names, at, size, own = symbols(span_hashes(data, starts, ends), owner)
                g = gram_hashes(names, gram)
                whole = own[: len(g)] == own[gram - 1 :][: len(g)]
                # grams across texts are set aside before choosing
                idx = np.nonzero(whole)[0]
                p = idx[picked(g[idx] | _U(1), choose, own[idx])]
                last = p + gram - 1
                n = at[last] + size[last] - at[p]
                pos = at[p] - first[own[p]]
                yield from out.add(g[p], (mix(g[p]) >> _U(32)), keys[own[p]], pos * 16 + n)
        yield from out.flush()

    return lean(run)


def _spread(total: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``total`` places lie in some span from a to b."""
    d = np.zeros(total + 1, dtype=np.int64)
    ok = b > a
    np.add.at(d, a[ok], 1)
    np.add.at(d, b[ok], -1)
    return np.cumsum(d)[:total] > 0


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of values in each list, all values); a null list has none."""
    return pc.list_value_length(lists).fill_null(0).to_numpy(), lists.flatten().to_numpy().astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], window: int, columns: list[str]):
    """(row keys, bytes, word starts, word ends, first words, windows that may repeat, (row of the block, value) of each list column)."""
    for batch in batches:
        lists = [_flat(batch.column(c)) for c in columns]
        upto = [np.append(0, np.cumsum(n)) for n, _ in lists]
        place = 0
        for keys, data, offs in text_blocks(batch.column("row_key").to_numpy(), unsqueeze(batch.column("z"))):
            starts, ends, first = word_spans(data, offs)
            i, j = place, place + len(keys)
            place = j
            held = [(np.repeat(np.arange(j - i), n[i:j]), v[u[i] : u[j]]) for (n, v), u in zip(lists, upto, strict=True)]
            owner, enc = held[0]
            pos, n, base = enc // 16, enc % 16, first[owner]
            may = _spread(len(starts), np.maximum(base + pos + n - window, base), np.minimum(base + pos, first[owner + 1] - window) + 1)
            if may.any():
                yield keys, data, starts, ends, first, may, held


def _words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of stretches of words, joined by one space whatever stands between them."""
    body = data.tobytes()
    odd = np.append(0, np.cumsum((starts[1:] - ends[:-1] != 1) | (data[ends[:-1]] != 0x20)))
    plain = odd[at + size - 1] == odd[at]
    h = bytearray()
    for a, b, p in zip(starts[at].tolist(), ends[at + size - 1].tolist(), plain.tolist(), strict=True):
        part = body[a:b]
        h += hashlib.blake2b(part if p else b" ".join(part.split()), digest_size=16).digest()
    both = np.frombuffer(bytes(h), _U).reshape(-1, 2)
    return both[:, 0], both[:, 1] >> _U(32)


def _high(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(buckets, False, mark=True)
        for keys, data, starts, ends, first, may, _ in _blocks(batches, window, ["at"]):
            owner = np.repeat(np.arange(len(keys)), np.diff(first))
            at, size = high_symbols(symbols(span_hashes(data, starts, ends), owner), window, TOP * window)
            # a symbol that holds a window of its own cannot be shared
            alone = np.append(0, np.cumsum(~may))
            ok = alone[at + size - window + 1] == alone[at]
            at, size = at[ok], size[ok]
            if len(at):
                h1, h2 = _words_of(data, starts, ends, at, size)
                yield from out.add(h1, h2, keys[owner[at]], ((at - first[owner[at]]) << _SIZE) | size)
        yield from out.flush()

    return lean(run)


def _marked(first: np.ndarray, owner: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, not the first of its name) of shared symbols."""
    enc = marks >> 1
    return first[owner] + (enc >> _SIZE), enc & ((1 << _SIZE) - 1), (marks & 1).astype(bool)


def _windows(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(buckets, False)
        for keys, data, starts, ends, first, may, held in _blocks(batches, window, ["at", "marks"]):
            at, size, later = _marked(first, *held[1])
            may = may & ~_spread(len(may), at[later], (at + size - window + 1)[later])
            at = np.nonzero(may)[0]
            if not len(at):
                continue
            h1 = gram_hashes(span_hashes(data, starts, ends, 0), window, 1)[at]
            h2 = gram_hashes(span_hashes(data, starts, ends, 1), window, 2)[at]
            own = np.searchsorted(first, at, side="right") - 1
            yield from out.add(h1, h2 >> _U(32), keys[own], at - first[own])
        yield from out.flush()

    return lean(run)


def repeats(keyed_docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, z, at, marks): compressed texts, first words of windows that repeat, and shared symbols, whose windows repeat too."""
    if TOP * window >= 1 << _SIZE:
        raise ValueError(f"a window holds at most {((1 << _SIZE) - 1) // TOP} words")
    n = bucket_count(keyed_docs)
    groups = repeated(keyed_docs.select("row_key", "text").mapInArrow(_anchors(window, n), BLOB), n)
    # one exchange of the texts for all joins: they are merge joins on the same rows and columns
    z = squeezed(keyed_docs).filter("row_key is not null").hint("merge")
    near = z.join(groups, "row_key").select("row_key", "doc_id", "z", "at")
    marks = repeated(near.mapInArrow(_high(window, n), BLOB), n, mark=True).withColumnRenamed("at", "marks")
    rest = near.hint("merge").join(marks, "row_key", "left").select("row_key", "doc_id", "z", "at", "marks")
    hits = repeated(rest.mapInArrow(_windows(window, n), BLOB), n)
    return z.join(marks, "row_key", "left").hint("merge").join(hits, "row_key", "left").select("doc_id", "z", "at", "marks")


def word_cover(n: int, at: np.ndarray, marks: np.ndarray, window: int) -> np.ndarray:
    a, size, _ = _marked(np.zeros(1, np.int64), np.zeros(len(marks), np.int64), marks)
    return _spread(n, np.append(at, a), np.append(at + window, a + size))


def _strip(window: int, keep_text: bool):
    """Kept text and counts of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists, shared = batch.column("doc_id"), unsqueeze(batch.column("z")), batch.column("at"), batch.column("marks")
            words, removed, digests, kept = [], [], [], []
            for i in range(batch.num_rows):
                body = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                w = body.split()
                gone = 0
                at, marks = (x[i].values.to_numpy() if x[i].is_valid else np.zeros(0, np.int64) for x in (lists, shared))
                if len(at) or len(marks):
                    cover = word_cover(len(w), at, marks, window)
                    gone = int(cover.sum())
                    left = [x for x, c in zip(w, cover.tolist(), strict=True) if not c]
                else:
                    left = w
                joined = b" ".join(left)
                words.append(len(w))
                removed.append(gone)
                digests.append(hashlib.sha256(joined).hexdigest())
                # a document that loses nothing keeps its own spacing
                kept.append((joined if gone else body).decode("utf-8") if keep_text else None)
            cols = [ids, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.string())] if keep_text else []), names=["doc_id", "n_words", "n_removed", "kept_sha256"] + (["kept_text"] if keep_text else []))

    return lean(run)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]): every word in a repeated window removed."""
    k = keyed(docs, id_col, text_col)
    return repeats(k, window).mapInArrow(_strip(window, keep_text), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if keep_text else ""))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir), keep_text=False)
