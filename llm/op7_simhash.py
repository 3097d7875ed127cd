"""SimHash near-dedup over a byte-position inverted index.

Fingerprints of 64 bits that differ in at most ``max_bits`` (2) agree in at least 6 of their 8 bytes.
The index lists fingerprints under the bytes they hold at given positions; a list key joins several
positions so that lists stay short at any corpus size: the 8 positions make 4 blocks of 2, two
differing bits leave at least two blocks untouched, so every linked pair shares a list of one of
the 6 pairs of blocks. For each pair that shares a list, equal positional bytes are counted; pairs
with 6 or more are verified by their bits.

Equal fingerprints are one node, so copies never pair up. A list longer than LONG_LIST (near
copies of one text, whatever their number) is not paired: each of its members is joined to the
values one bit flip away (and itself), as two values two flips apart have one of those in common.
That is linear in the list and needs no group in one task. Components come from rounds of minimum
labels over star edges.

Edge cases: null and empty texts have fingerprint 0 and link like any other; repeated ids stay rows;
ids may be null (such rows link, but do not name a component unless it has no other id).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.workspace import discard, materialise
from llm.common import documents, lean, squeezed, word_spans
from llm.exchange import bucket_count

LONG_LIST = 64
POSITIONS = 8
#: Bytes from which a text is looked at in stretches.
LONG_TEXT = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _words(low: bytes) -> Iterator[list[bytes]]:
    """The words of a text, LONG_TEXT bytes at a time."""
    if len(low) <= LONG_TEXT:
        yield low.split()
        return
    data = np.frombuffer(low, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(low)]))
    cuts = np.append(np.unique(np.searchsorted(starts, np.arange(0, len(low), LONG_TEXT))), len(starts)).tolist()
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i < j:
            yield low[starts[i] : ends[j - 1]].split()


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``size`` consecutive words, space-joined; of all words, if there are fewer."""
    h, out, words = xxhash.xxh64_intdigest, [], []
    for more in _words(text.translate(_LOWER)):
        words += more
        if len(words) < size:
            continue
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - size + 1].tolist()
        out.append(np.fromiter((h(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts)))
        words = words[len(words) - size + 1 :]
    if out:
        return np.concatenate(out)
    return np.array([h(b" ".join(words), 42)] if words else [], dtype=np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bit set if set in more than half the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded, however long the text
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.nonzero(2 * ones > len(h))[0].tolist())


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(1)
            f = np.fromiter((fingerprint(shingle_hashes(x.as_buffer().to_pybytes() if x.is_valid else b"", size)) for x in t), np.uint64, len(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], names=["doc_id", "fp"])

    return lean(run)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint): one row per input row."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_fingerprints(shingle), "doc_id bigint, fp bigint")


def equal_bytes(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum(((F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255))) == 0).cast("int") for p in range(POSITIONS))


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): edges whose components are those of the graph "at most max_bits apart", over distinct fingerprints ``fp``."""
    if max_bits != 2:
        raise ValueError("the index is laid out for two differing bits")
    blocks = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.struct(F.lit(k).alias("place"), (F.shiftleft(blocks[i], 16).bitwiseOR(blocks[j])).alias("bytes")) for k, (i, j) in enumerate(combinations(range(4), 2))]
    listed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.place", "k.bytes")
    lengths = listed.groupBy("place", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    lengths = materialise(lengths)
    posted = materialise(listed.join(lengths, ["place", "bytes"]))
    short = posted.filter(F.col("n") <= LONG_LIST)
    a, b = short.select("place", "bytes", F.col("fp").alias("a")), short.select("place", "bytes", F.col("fp").alias("b"))
    pairs = a.join(b, ["place", "bytes"]).filter(F.col("a") < F.col("b")).select("a", "b")
    pairs = pairs.filter(equal_bytes(F.col("a"), F.col("b")) >= POSITIONS - max_bits).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # members of long lists meet at values one flip away; the least member of each value is its star's centre
    long = posted.filter(F.col("n") > LONG_LIST).select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("bigint") for i in range(64)])
    met = long.select("fp", F.explode(flips).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    centre = met.groupBy("v").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("v", "a")
    stars = met.join(materialise(centre), "v").filter(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b"))
    out = materialise(pairs.unionByName(stars).distinct())
    discard(lengths, posted)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of an edge can reach. Large-star and small-star rounds, each written once."""
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written first, so that Spark can split the rows of a hub in the join
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # large star: larger neighbours of u go to the least of u and its neighbours
        large = materialise(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: smaller neighbours of u, and u itself, go to the least of them
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(e, least, large, low)
        e = now
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        if now == before:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
            out._keytide_table = e._keytide_table
            return out
        before = now


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    f = materialise(fingerprints(docs, shingle, id_col, text_col))
    nodes = materialise(f.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(links(nodes.select("fp"), max_bits))
    named = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    best = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = materialise(named.select("fp", "label").join(best, "label").select("fp", "component_id"))
    return f.join(of, "fp").select("doc_id", "fp", "component_id")


BANDS, ROWS = 24, 5
_MULTIPLIERS = np.random.default_rng(7).integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = "doc_id bigint, k bigint, n int, fp bigint, sig binary, bands array<bigint>"
#: A pair is verified if its equal bytes are no more than so many standard errors below the number expected at the threshold.
ERRORS = 3
#: Rounds in which a long list names a champion; more rounds leave fewer pairs, the components are the same.
CHAMPIONS = 2
EPSILON = 1e-9


def _slices(batch: pa.RecordBatch, rows: int = 64, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Some rows at a time: no more than ``rows``, and about ``limit`` bytes of text (column 2)."""
    upto, i = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)), 0
    while i < batch.num_rows:
        j = min(i + rows, max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + limit, side="right"))))
        yield batch.slice(i, j - i)
        i = j


def _signatures(size: int):
    """Of each text: distinct shingles, SimHash, one positional byte for each of BANDS * ROWS minima of the shingle hashes, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(2)]
                hashes = [shingle_hashes(x, size) for x in texts]
                fps = np.fromiter(map(fingerprint, hashes), np.uint64, len(texts))
                hashes = [np.unique(h) for h in hashes]
                count = pa.array([len(h) for h in hashes], pa.int32())
                hashes = [h if len(h) else np.zeros(1, np.uint64) for h in hashes]
                first = np.cumsum([0] + [len(h) for h in hashes])[:-1]
                every = np.concatenate(hashes)
                low = np.stack([np.minimum.reduceat(every * m, first) for m in _MULTIPLIERS], axis=1)
                key = np.zeros((len(texts), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + (low[:, r::ROWS] ^ (low[:, r::ROWS] >> np.uint64(29)))
                sig = (low >> np.uint64(8)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), count, pa.array(fps.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(list(key.view(np.int64)), pa.list_(pa.int64()))],
                    names=["doc_id", "k", "n", "fp", "sig", "bands"],
                )

    return lean(run)


def _tally(least: int):
    """Pairs that share at least ``least`` positional bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in ("sa", "sb"))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return lean(run)


def tallied(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures share at least ``least`` positional bytes."""
    sig = nodes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_tally(least), "a bigint, b bigint")


def _shingle_set(z: pa.Scalar, size: int) -> np.ndarray:
    text = zstandard.ZstdDecompressor().decompress(z.as_buffer()) if len(z.as_buffer()) else b""
    return np.unique(shingle_hashes(text, size))


def _verify(size: int, similarity: float):
    """Pairs whose shingle sets have the similarity. Rows of one b come together, so its set is kept; of other sets, the last few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(node: int, z: pa.Scalar) -> np.ndarray:
            s = kept.pop(node, None)
            if s is None:
                s = _shingle_set(z, size)
            kept[node] = s  # last used, last to go
            if len(kept) > 64:
                del kept[next(iter(kept))]
            return s

        for batch in batches:
            good = []
            for a, b, za, zb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = of(a, za), of(b, zb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - EPSILON)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return lean(run)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity, by all their shingles."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
    return both.select("a", "b", "za", "zb").mapInArrow(_verify(shingle, similarity), "a bigint, b bigint")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, z): the compressed text of each node of ``wanted`` (node, doc_id, k), from the rows of ``docs`` (row_key, doc_id, text)."""
    w = wanted.select("node", F.col("doc_id").alias("rep"), F.col("k").alias("row_key"))
    # the join moves the texts at every size, so that what it costs grows with the input alone
    found = squeezed(docs).join(w.hint("merge"), "row_key").filter(F.col("doc_id").eqNullSafe(F.col("rep")))
    return materialise(found.groupBy("node").agg(F.first("z").alias("z")))  # rows that repeat id and text are one


_PACKED = "bucket int, n bigint, body binary"


def _packed(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a bucket: its entries, column after column."""
    o = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.nonzero(np.diff(bucket[o]))[0] + 1, [len(o)]])
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if i < j:
            k = o[i:j]
            body = b"".join(x[k].tobytes() for x in columns)
            yield pa.RecordBatch.from_arrays([pa.array([bucket[k[0]]], pa.int32()), pa.array([j - i], pa.int64()), pa.array([body], pa.binary())], names=["bucket", "n", "body"])


def _unpacked(batches: Iterator[pa.RecordBatch], *types: type) -> list[np.ndarray]:
    """The entries of all rows, a column each; none if there are no rows."""
    parts = []
    for b in batches:
        for n, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            at = np.cumsum([0, *(np.dtype(t).itemsize * n for t in types)]).tolist()
            parts.append([np.frombuffer(body, t, n, i) for t, i in zip(types, at, strict=False)])
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _heads(x: np.ndarray) -> np.ndarray:
    """Where values of a sorted array begin."""
    return np.nonzero(np.append(True, x[1:] != x[:-1]))[0] if len(x) else np.zeros(0, np.int64)


def _postings(size: int, buckets: int):
    """Of each text (node, z), its distinct shingles, packed for their buckets: shingles, nodes, and whether a shingle is common already.

    A shingle that more than LONG_LIST texts of one flush have is sent once, as common.
    """

    def send(held: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x[1] for x in held])
        node = np.repeat(np.array([x[0] for x in held], dtype=np.int64), [len(x[1]) for x in held])
        o = np.argsort(h, kind="stable")
        h, node = h[o], node[o]
        head = _heads(h)
        count = np.diff(np.append(head, len(h)))
        common = np.repeat(count > LONG_LIST, count)
        keep = ~common
        keep[head] = True
        h, node, common = h[keep], node[keep], common[keep]
        yield from _packed((h % np.uint64(buckets)).astype(np.int32), h, node, common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for node, z in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append((node, _shingle_set(z, size)))
                n += len(held[-1][1])
                if n >= 1 << 19:
                    yield from send(held)
                    held, n = [], 0
        if held:
            yield from send(held)

    return lean(run)


def _rare(limit: int, buckets: int):
    """Of a bucket of shingles: those of at most ``limit`` texts, packed for the buckets of their texts: shingles, nodes, numbers of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _unpacked(batches, np.uint64, np.int64, np.bool_)
        if not found:
            return
        h, node, common = found
        o = np.argsort(h, kind="stable")
        h, node, common = h[o], node[o], common[o]
        head = _heads(h)
        count = np.diff(np.append(head, len(h)))
        rare = np.repeat((count <= limit) & ~np.maximum.reduceat(common, head), count)
        texts = np.repeat(count, count).astype(np.int32)
        yield from _packed((node[rare].view(np.uint64) % np.uint64(buckets)).astype(np.int32), h[rare], node[rare], texts[rare])

    return lean(run)


def _rare_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, u, rare): each text's u rare shingles, those of the fewest texts first."""
    found = _unpacked(batches, np.uint64, np.int64, np.int32)
    if not found:
        return
    h, node, texts = found
    o = np.lexsort((h, texts, node))
    h, node = h[o], node[o]
    cuts = np.append(_heads(node), len(node)).tolist()
    for k in range(0, len(cuts) - 1, 4096):
        c = cuts[k : k + 4097]
        body = [h[i:j].tobytes() for i, j in zip(c[:-1], c[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(node[c[:-1]]), pa.array(np.diff(c), pa.int32()), pa.array(body, pa.binary())], names=["node", "u", "rare"])


def _prefixes(similarity: float, buckets: int):
    """Of each text (node, label, n, rare), what is rare among its first shingles in the order of (texts that have it, hash), packed for their buckets.

    A text that links has at least ``similarity`` of its n shingles in common with the other, so the first one in common stands among
    the first n - ceil(similarity * n) + 1 of both; if any of those in common is rare, the first is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(2).to_numpy()
            first = (n - np.ceil(similarity * n - EPSILON) + 1).astype(np.int64).tolist()
            h = [np.frombuffer(x, np.uint64)[:k] for x, k in zip(b.column(3).to_pylist(), first, strict=True)]
            node, label, size = (np.repeat(b.column(k).to_numpy(), [len(x) for x in h]) for k in range(3))
            h = np.concatenate(h)
            yield from _packed((h % np.uint64(buckets)).astype(np.int32), h, node, label, size.astype(np.int32))

    return lean(run)


def _met(similarity: float):
    """Of a bucket: pairs (a, b) of texts of two components that have a shingle in common and sizes that allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _unpacked(batches, np.uint64, np.int64, np.int64, np.int32)
        if not found:
            return
        o = np.lexsort((found[1], found[0]))
        h, node, label, size = (x[o] for x in found)
        for step in range(1, len(h)):
            same = h[step:] == h[:-step]
            if not same.any():
                break
            x, y = size[:-step], size[step:]
            hit = same & (label[step:] != label[:-step]) & (np.minimum(x, y) >= np.maximum(x, y) * similarity - EPSILON)
            both = np.unique(np.stack([node[:-step][hit], node[step:][hit]], axis=1), axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return lean(run)


def _dominated(size: int):
    """The pairs (champ, node) where every common shingle of the node is one of the champion's, which has no more shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, top = None, np.zeros(0, np.uint64)
        for b in batches:
            good = []
            for champ, zc, zn, rare in zip(b.column(0).to_pylist(), b.column(2), b.column(3), b.column(4), strict=True):
                if champ != last:
                    last, top = champ, _shingle_set(zc, size)
                x = _shingle_set(zn, size)
                rest = np.setdiff1d(x, top, assume_unique=True)
                own = np.frombuffer(rare.as_py(), np.uint64)
                good.append(len(top) <= len(x) and bool(np.isin(rest, own).all()))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["champ", "node"])

    return lean(run)


def across(long: DataFrame, nodes: DataFrame, texts: DataFrame, comp: DataFrame, shingle: int, similarity: float) -> DataFrame | None:
    """Pairs (a, b) that complete the components of long lists; None if each list is within one component.

    Members of a list whose components differ could all be paired; the components come out the same from far fewer pairs.
    Call a shingle rare if at most LONG_LIST of these texts have it.

    Texts that share a rare shingle are paired by the first ones of each in order of rarity (``_prefixes``), which is linear and leaves out no link. For all other pairs, rare shingles lie in the union and not
    in the intersection: with c common and u rare shingles, a pair reaches at most m / (m + ua + ub), where m is the smaller c;
    below the similarity it cannot link. Of the rest, a text y with all common shingles of z and no more shingles in all is at least as
    similar to any x as z is (|x & z| <= |x & y|, |y| <= |z|). So z need only meet such texts: if x and z link, x links with the y of z, z with the y
    of x, and those two link. In each list, members dominated by the champion of a round (the most common shingles, then the fewest
    rare ones) leave; all members meet the champions and what is left.
    """
    own = ["place", "key"]
    named = long.select(*own, "node").join(comp, "node", "left").select(*own, "node", F.coalesce("label", "node").alias("label"))
    named = materialise(named)
    mixed = materialise(named.groupBy(*own).agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select(*own))
    if mixed.limit(1).count() == 0:
        return None
    named = materialise(named.join(mixed, own))
    label = named.select("node", "label").distinct()
    held = materialise(texts.join(label, "node").select("node", "label", "z"))
    parts, limit = bucket_count(held), LONG_LIST
    packed = held.select("node", "z").mapInArrow(_postings(shingle, parts), _PACKED).repartition(parts, "bucket").mapInArrow(_rare(limit, parts), _PACKED).repartition(parts, "bucket")
    rare = materialise(packed.mapInArrow(lean(_rare_of_texts), "node bigint, u int, rare binary"))
    sized = rare.join(label, "node").join(nodes.select("node", "n"), "node").select("node", "label", "n", "rare")
    by_rare = sized.mapInArrow(_prefixes(similarity, parts), _PACKED).repartition(parts, "bucket").mapInArrow(_met(similarity), "a bigint, b bigint")

    possible = lambda m, u: m * (1 - similarity) >= u * similarity - EPSILON
    of = held.select("node", "z").join(nodes.select("node", "n"), "node").join(rare, "node", "left")
    of = of.select("node", "z", F.coalesce("rare", F.lit(b"")).alias("rare"), "n", F.coalesce("u", F.lit(0)).alias("u")).withColumn("c", F.col("n") - F.col("u"))
    of = materialise(of.filter(possible(F.col("c"), F.col("u"))))
    members = materialise(named.join(of.select("node", "c", "u"), "node").select(*own, "node", "label", "c", "u"))
    left, met = members, None
    for _ in range(CHAMPIONS):
        champ = materialise(left.groupBy(*own).agg(F.max_by("node", F.struct("c", -F.col("u"), "node")).alias("champ")))
        led = left.join(champ, own).filter("node <> champ")
        tests = led.select("champ", "node").distinct().join(of.select(F.col("node").alias("champ"), F.col("z").alias("zc")), "champ").join(of.select("node", F.col("z").alias("zn"), "rare"), "node")
        gone = materialise(tests.select("champ", "node", "zc", "zn", "rare").mapInArrow(_dominated(shingle), "champ bigint, node bigint"))
        chosen = members.select(*own, "node", "label", "c", "u").join(champ.withColumnRenamed("champ", "node"), [*own, "node"])
        met = chosen if met is None else met.unionByName(chosen)
        left = materialise(led.join(gone, ["champ", "node"], "left_anti").select(*members.columns))
    named_as = lambda d, x: d.select(*own, *[F.col(k).alias(f"{k}_{x}") for k in ("node", "label", "c", "u")])
    both = named_as(members, "a").join(named_as(materialise(met.unionByName(left)), "b"), own)
    both = both.filter("label_a <> label_b").filter(possible(F.least("c_a", "c_b"), F.col("u_a") + F.col("u_b")))
    pairs = both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    out = materialise(pairs.unionByName(by_rare).distinct())
    discard(held, rare, of, members, left)
    return out


def across_short(short: DataFrame, comp: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members of short lists whose components differ and whose sizes allow the similarity; those with the least member were looked at before."""
    own = ["place", "key"]
    named = materialise(short.join(comp, "node", "left").select(*own, "node", "n", "centre", F.coalesce("label", "node").alias("label")))
    mixed = materialise(named.groupBy(*own).agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select(*own))
    named = named.join(mixed, own).filter(F.col("node") != F.col("centre"))
    a, b = (named.select(*own, F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("label").alias(f"l{x}")) for x in "ab")
    alike = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - EPSILON
    return a.join(b, own).filter("a < b and la <> lb").filter(alike).select("a", "b").distinct()


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for near copies: documents linked by shingle sets with a Jaccard similarity of ``similarity`` or more.

    Texts of that similarity differ in up to a quarter of their SimHash bits, too many for byte matches to be sure.
    So the same positional index is also kept over bytes of shingle minima, whose chance to match is the similarity
    itself: pairs that share a band are tallied by equal positional bytes, and from the expected number less ERRORS standard
    errors on they are verified by all shingles of both texts, as are SimHash links (2 bits). Distinct signatures are
    the nodes (texts that agree in the SimHash and all bytes are copies). The nodes of a band first meet its least one; those that
    then are in different components are paired too, all of them in bands of up to LONG_LIST nodes (``across_short``), in
    longer ones those that can matter (``across``). The components are those of all pairs.

    Null and empty texts have no shingles and are copies of one another; a text of fewer words than a shingle is one shingle. Repeated
    rows and rows without an id stay rows; a component of such rows only has the id null. Other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text")
    f = materialise(d.select("doc_id", F.col("row_key").alias("k"), "text").mapInArrow(_signatures(shingle), _SIGNED).withColumn("node", F.xxhash64("fp", "sig")))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "n"))
    nodes = f.groupBy("node").agg(rep.alias("rep"), F.first("fp").alias("fp"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.select("node", F.col("rep.doc_id").alias("least"), F.col("rep.k").alias("k"), F.col("rep.n").alias("n"), "fp", "sig", "bands"))
    listed = nodes.select("node", "n", F.posexplode("bands").alias("place", "key"))
    lengths = materialise(listed.groupBy("place", "key").agg(F.count("*").alias("listed"), F.min("node").alias("centre")).filter("listed > 1"))
    posted = materialise(listed.join(lengths, ["place", "key"]))
    n = BANDS * ROWS
    least = int(n * similarity - ERRORS * (n * similarity * (1 - similarity)) ** 0.5)
    # first, members of each list meet its least one: that links most of what links at all
    stars = materialise(posted.filter(F.col("node") != F.col("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    # nodes of one SimHash meet its least node, and so do SimHashes two bits apart
    heads = materialise(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    bits = links(heads.select("fp"))
    bits = bits.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    near = materialise(tallied(stars, nodes, least).unionByName(same).unionByName(bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).unionByName(posted.select("node")).distinct()
    wanted = materialise(nodes.select("node", F.col("least").alias("doc_id"), "k").join(wanted, "node"))
    texts = texts_of(d, wanted)
    comp = components(verified(near, texts, shingle, similarity))
    discard(stars, heads, near, wanted)
    # then those of short lists that are in different components yet meet each other, and those of long lists fewer
    long = posted.filter(F.col("listed") > LONG_LIST)
    pairs, more = across_short(posted.filter(F.col("listed") <= LONG_LIST), comp, similarity), across(long, nodes, texts, comp, shingle, similarity)
    meet = materialise(tallied(pairs if more is None else pairs.unionByName(more).distinct(), nodes, least))
    found = components(verified(meet, texts, shingle, similarity).unionByName(comp.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    discard(comp, more, meet, texts, lengths, posted)
    comp = found
    named = nodes.select("node", "least").join(comp, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    best = materialise(named.groupBy("label").agg(F.min("least").alias("component_id")))
    of = materialise(named.join(best, "label").select("node", "component_id"))
    discard(comp, best, nodes)
    return f.select("doc_id", "node").join(of, "node").select("doc_id", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = near_duplicates(documents(spark, sf_dir))
    return r.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
