"""Token ids of whole texts by a byte-level BPE of the tokenizers library, fast on long corpora.

The library splits a text into words before it merges bytes, and merges never cross words, so the
ids of a text are the ids of its words in a row. Words are cut by numpy over UTF-8 bytes and told apart by Arrow's
dictionary encoding, so only the different words of a chunk become Python objects; each new one is encoded once by the
library and remembered in arrays of bounded size (``Memory``). Long texts are cut where the library would cut too (``safe_cuts``), so a chunk
stays small whatever the text. Stretches that hold anything the cutter does not model (rare white space, scripts beyond
Latin, contractions after an apostrophe, special-token strings) go to the library whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from llm.common import ragged, span_hashes

#: Words remembered at most, and bytes of these words, and ids; about 45 MB in all. What is full is emptied.
REMEMBERED_WORDS, REMEMBERED_BYTES, REMEMBERED_IDS = 1 << 20, 12 << 20, 4 << 20
#: Bytes looked at together, and bytes from which a text is cut.
CHUNK, PIECE = 1 << 18, 1 << 14
_L, _N, _S, _O = 1, 2, 3, 4
_state: dict[str, WordTokenizer] = {}


def _byte_classes() -> np.ndarray:
    """Letter, digit, white space or other for each byte; 0: not modelled. Bytes above 0x7F stand for U+00C0 to U+023F."""
    t = np.zeros(256, dtype=np.uint8)
    for b in range(0x80):
        c = chr(b)
        t[b] = _L if c.isalpha() else _N if c.isdigit() else _O
    t[[0x20, *range(0x09, 0x0E)]] = _S
    t[0x1C:0x20] = 0
    t[0x80:0xC0] = _L
    t[0xC3:0xC9] = _L
    return t


_CLASSES = _byte_classes()
_CONTRACTION = np.zeros(256, dtype=bool)
_CONTRACTION[list(b"stmdrvl")] = True


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places where the library always begins a new word: a single blank between two ASCII letters, in whatever script the rest is."""
    letter = _ASCII_LETTER[data]
    return np.nonzero((data[1:-1] == 0x20) & letter[:-2] & letter[2:])[0] + 1


def pieces(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """``offs``, with safe cuts about every PIECE bytes put in."""
    long = np.nonzero(np.diff(offs) > PIECE)[0]
    if not len(long):
        return offs
    extra = [offs]
    for k in long.tolist():
        a, z = int(offs[k]), int(offs[k + 1])
        for i in range(a, z, 64 * PIECE):  # in stretches, so that a very long text needs no array of its length
            at = safe_cuts(data[i : min(i + 64 * PIECE, z)]) + i
            if len(at):
                want = np.arange(i + PIECE, min(i + 64 * PIECE, z) + 1, PIECE)
                extra.append(at[np.unique(np.minimum(np.searchsorted(at, want), len(at) - 1))])
    return np.sort(np.concatenate(extra), kind="stable")


def grown(a: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``a``, whose first n values count, with ``more`` after them; room doubles, so adding is cheap."""
    if n + len(more) > len(a):
        a = np.concatenate([a[:n], np.zeros(max(n, len(more), 1024) + len(more), a.dtype)])
    a[n : n + len(more)] = more
    return a


class Memory:
    """Words and their ids in an open hash table of arrays: about 40 bytes a word in place of 200 for Python objects. Words are compared by their bytes."""

    def __init__(self) -> None:
        self.slots = np.full(2 * REMEMBERED_WORDS, -1, dtype=np.int32)
        self.n = self.n_bytes = self.n_ids = 0
        self.hashes, self.words, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        # first byte and first id of each word, and how many it has
        self.word_at, self.ids_at, self.size, self.count = (np.zeros(0, np.int32) for _ in range(4))

    def find(self, h: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Entry of each word data[offs[k]:offs[k + 1]] with hash h[k]; -1: not there."""
        out = np.full(len(h), -1, dtype=np.int64)
        if not self.n:
            return out
        todo, at, mask = np.arange(len(h)), h.astype(np.int64) & (len(self.slots) - 1), len(self.slots) - 1
        while len(todo):
            e = self.slots[at]
            there = e >= 0
            todo, at, e = todo[there], at[there], e[there]
            same = self.hashes[e] == h[todo]
            out[todo[same]] = e[same]
            todo, at = todo[~same], (at[~same] + 1) & mask
        k = np.nonzero(out >= 0)[0]
        e, size = out[k], np.diff(offs)[k]
        good = self.size[e] == size
        k, e, size = k[good], e[good], size[good]
        differ = ragged(self.words, self.word_at[e], size) != ragged(data, offs[k], size)
        wrong = np.bincount(np.repeat(np.arange(len(k)), size)[differ], minlength=len(k)) > 0
        checked = np.full(len(h), -1, dtype=np.int64)
        checked[k[~wrong]] = e[~wrong]
        return checked

    def add(self, h: np.ndarray, words: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        """New, different words, and the ids of all in a row; what was there goes if there is no room for all."""
        size, text = np.fromiter(map(len, words), np.int64, len(words)), np.frombuffer(b"".join(words), np.uint8)
        if self.n + len(words) > REMEMBERED_WORDS or self.n_bytes + len(text) > REMEMBERED_BYTES or self.n_ids + len(ids) > REMEMBERED_IDS:
            self.__init__()
            if len(words) > REMEMBERED_WORDS:
                return
        new = self.n + np.arange(len(words))
        self.hashes = grown(self.hashes, self.n, h)
        self.word_at, self.size = grown(self.word_at, self.n, self.n_bytes + np.cumsum(size) - size), grown(self.size, self.n, size)
        self.ids_at, self.count = grown(self.ids_at, self.n, self.n_ids + np.cumsum(count) - count), grown(self.count, self.n, count)
        self.words, self.ids = grown(self.words, self.n_bytes, text), grown(self.ids, self.n_ids, ids)
        self.n, self.n_bytes, self.n_ids = self.n + len(words), self.n_bytes + len(text), self.n_ids + len(ids)
        todo, at, mask = new, h.astype(np.int64) & (len(self.slots) - 1), len(self.slots) - 1
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several that want one slot, one gets it
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & mask


class WordTokenizer:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [str(t.content).encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.memory = Memory()

    def forget(self) -> None:
        self.memory = Memory()

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has)."""
        out, counts, i = [], [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and j - i < 512 and (j == i or size + len(texts[j]) <= CHUNK):
                size, j = size + len(texts[j]), j + 1
            got = [e.ids for e in self.lib.encode_batch_fast(texts[i:j], add_special_tokens=False)]
            counts += map(len, got)
            out.append(np.array(list(chain.from_iterable(got)), dtype=np.uint32))
            i = j
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.array(counts, dtype=np.int64)

    def unmodelled(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which pieces must go to the library whole."""
        odd = kind == 0
        # U+00D7 and U+00F7 are no letters; an apostrophe before certain letters may be a contraction
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0x27) & _CONTRACTION[data[1:]]
        at = np.nonzero(odd)[0].tolist()
        raw = data.tobytes()
        for s in self.special:
            p = raw.find(s)
            while p >= 0:
                at.append(p)
                p = raw.find(s, p + 1)
        out = np.zeros(len(offs) - 1, dtype=bool)
        out[np.searchsorted(offs, np.array(at, dtype=np.int64), side="right") - 1] = len(at) > 0
        return out

    def _chunk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, how many each has)."""
        n = len(data)
        kind = _CLASSES[data]
        whole = self.unmodelled(data, offs, kind)
        edge = offs[(offs > 0) & (offs < n)]
        begin = np.ones(n, dtype=bool)
        begin[1:] = kind[1:] != kind[:-1]
        begin[edge] = True
        # the last white space before a word stands alone, or goes with the word if it is a blank
        space = kind == _S
        last = np.zeros(n, dtype=bool)
        last[:-1] = space[:-1] & ~space[1:]
        last[edge - 1] = False
        begin |= last
        begin[1:] &= ~(last[:-1] & (data[:-1] == 0x20))
        # a piece that goes to the library is one word of its own
        odd = np.nonzero(whole)[0]
        for k in odd.tolist():
            begin[offs[k] : offs[k + 1]] = False
            begin[offs[k]] = True
        at = np.nonzero(begin)[0]
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, n).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        which, names = coded.indices.to_numpy(), coded.dictionary
        n_names = len(names)
        name_at = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + n_names + 1].astype(np.int64)
        name_bytes = np.frombuffer(names.buffers()[2], np.uint8)[: name_at[-1]]
        alone = np.zeros(n_names, dtype=bool)
        if len(odd):
            alone[which[np.searchsorted(at, offs[odd])]] = True  # these are not remembered: they are long and do not come back
        h = span_hashes(name_bytes, name_at[:-1], name_at[1:])
        entry = self.memory.find(h, name_bytes, name_at)
        entry[alone] = -1
        missing = np.nonzero(entry < 0)[0]
        strange = names.take(pa.array(missing)).to_pylist()
        told, n_told = self._library([w.decode() for w in strange])
        hit = np.nonzero(entry >= 0)[0]
        e = entry[hit]
        pool = np.concatenate([ragged(self.memory.ids, self.memory.ids_at[e], self.memory.count[e]), told])
        size = np.zeros(n_names, np.int64)
        size[hit], size[missing] = self.memory.count[e], n_told
        start, placed = np.zeros(n_names, np.int64), np.concatenate([hit, missing])
        start[placed] = np.cumsum(size[placed]) - size[placed]
        usual = np.nonzero(~alone[missing])[0]
        if len(usual):
            _, once = np.unique(h[missing[usual]], return_index=True)  # of words with one hash, one is remembered
            usual = usual[once]
            at_told = np.cumsum(n_told) - n_told
            self.memory.add(h[missing[usual]], [strange[i] for i in usual.tolist()], ragged(told, at_told[usual], n_told[usual]), n_told[usual])
        count = size[which]
        out = ragged(pool, start[which], count)
        upto = np.append(0, np.cumsum(count))
        return out, np.diff(upto[np.searchsorted(at, offs)])

    def encode_block(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Ids (uint32) of the texts data[offs[k]:offs[k + 1]]."""
        offs = np.asarray(offs, dtype=np.int64)
        cuts = pieces(data, offs)
        parts, counts, a = [np.zeros(0, np.uint32)], [], 0
        while a < len(cuts) - 1:
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + CHUNK, side="right")) - 1)
            if cuts[b] > cuts[a]:
                ids, n = self._chunk(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
                parts.append(ids)
            else:
                n = np.zeros(b - a, np.int64)
            counts.append(n)
            a = b
        flat = np.concatenate(parts)
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        at = upto[np.searchsorted(cuts, offs)]
        # empty texts share their place with the next one's first piece; the last text ends with everything
        return [flat[i:j] for i, j in zip(at[:-1].tolist(), [*at[1:-1].tolist(), len(flat)], strict=True)]


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    if path not in _state:
        _state[path] = WordTokenizer(path)
    return _state[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
