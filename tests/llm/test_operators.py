"""Operators against brute force on small tables with nulls, empty and long texts, copies, repeated ids and clashing columns."""

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

pytest.importorskip("llm")

from llm import op1_segment_topk, op2_suffix_dedup, op3_arc_to_warc, op4_decontamination, op5_simple8b, op6_packing, op7_simhash, op8_recompression, op9_licenses, op10_toxicity  # noqa: E402
from llm.suffixes import suffix_array  # noqa: E402
from llm.tokens import default_path, tokenizer  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key int, at string, z int"


def rows(texts, first=0):
    return [(first + i, t, "en", "s", len(t or ""), 1, "x", 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rnd.choices(vocab, k=60))
    base = " ".join(rnd.choices(vocab, k=300))
    out = [None, "", " \n\t", "one", "a a a a " * 60, "b" * 400]
    out += [" ".join(rnd.choices(vocab, k=rnd.randint(1, 120))) for _ in range(25)]
    out += [" ".join(rnd.choices(vocab, k=20)) + " " + passage + " " + " ".join(rnd.choices(vocab, k=20)) for _ in range(8)]
    out += [base, base, base, base.replace(" ", "\n", 3), " ".join(w if i % 60 else "edit" for i, w in enumerate(base.split()))]
    out += [" ".join(rnd.choices(vocab, k=6000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def odd(spark, texts):
    """Null and repeated ids, repeated rows."""
    r = [(i if i % 5 else None, *x[1:]) for i, x in enumerate(rows(texts))]
    return spark.createDataFrame(r + r[6:9] + r[6:8], SCHEMA)


def test_suffix_array():
    for n in (1, 2, 5, 299, 300, 301, 1500):
        for k in (1, 2, 90):
            t = np.random.default_rng(n).integers(1, k + 1, n)
            assert suffix_array(t).tolist() == sorted(range(n), key=lambda i: t.tolist()[i:])


def bytes_oracle(texts, length):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_op2(docs, texts):
    got = {r[0]: tuple(r)[1:] for r in op2_suffix_dedup.dedup_bytes(docs).collect()}
    assert got == bytes_oracle(texts, 100)


def test_op2_large_groups(docs, texts, monkeypatch):
    monkeypatch.setattr(op2_suffix_dedup, "PIECE", 600)  # workers start from the driver's value, sent with the function
    got = {r[0]: tuple(r)[1:] for r in op2_suffix_dedup.dedup_bytes(docs).collect()}
    assert got == bytes_oracle(texts, 100)


def test_op2_contexts_of_copies_and_periods(spark):
    """Copies, partial copies and periodic runs, so that anchors have one context, several, or themselves twice in one."""
    rnd = random.Random(1)
    mk = lambda al, n: "".join(rnd.choices(al, k=n))
    blocks = [mk("abcdefgh", rnd.randint(40, 200)) for _ in range(4)] + ["a" * 150, "ab" * 90, mk("ab", 160)]
    t = ["".join(rnd.choice(blocks) if rnd.random() < 0.7 else mk("abcdefgh", 60) for _ in range(rnd.randint(0, 5))) for _ in range(40)]
    t += t[:12]
    got = {r[0]: tuple(r)[1:] for r in op2_suffix_dedup.dedup_bytes(spark.createDataFrame(rows(t), SCHEMA).repartition(3)).collect()}
    assert got == bytes_oracle(t, 100)


def windows_oracle(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = {}
    for i, w in enumerate(words):
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def windows_removed(docs, window=35):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op8_recompression.dedup_substrings(docs, window).collect()}


def test_op8(docs, texts):
    assert windows_removed(docs) == windows_oracle(texts, 35)


@pytest.mark.parametrize("window", [14, 35, 60])
def test_op8_shared_symbols(spark, window):
    """Long passages held whole, in part, shifted, within one document and with other spacing; periods and runs; a passage held by a third of all."""
    rnd = random.Random(window)
    mk = lambda n, al=400: [f"w{rnd.randrange(al)}" for _ in range(n)]
    hot, long = mk(300), mk(3000)
    blocks = [mk(rnd.randint(20, 400)) for _ in range(6)] + [["a"] * 130, ["a", "b"] * 90, mk(200, 2)]
    t = []
    for i in range(60):
        parts = [mk(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 4)):
            b = rnd.choice(blocks)
            i0 = rnd.randrange(len(b))
            parts += [b[i0 : i0 + rnd.randint(1, len(b))] if rnd.random() < 0.5 else b, mk(rnd.randint(0, 40))]
        if i % 3 == 0:
            parts.append(hot)
        if i % 20 == 1:
            parts.append(long[i * 10 : i * 10 + 2000])
        t.append(rnd.choice([" ", "  ", "\n"]).join(x for p in parts for x in p))
    t += [t[0], t[1], None, "", " ".join(long + long)]
    assert windows_removed(spark.createDataFrame(rows(t), SCHEMA).repartition(5), window) == windows_oracle(t, window)


def test_op8_equal_stretches_share_symbols():
    """Of two equal stretches, all but EDGE words at either end are under the same low symbols, and high ones are shared."""
    rnd = np.random.default_rng(3)
    for _ in range(200):
        same = rnd.integers(0, 3, 35).astype(np.uint64)
        seen = []
        for _ in range(2):
            before, after = rnd.integers(0, 3, rnd.integers(0, 9)).astype(np.uint64), rnd.integers(0, 3, rnd.integers(0, 9)).astype(np.uint64)
            w = np.concatenate([before, same, after])
            names, at, size, _ = op8_recompression.symbols(w, np.zeros(len(w), np.int64))
            assert size.sum() == len(w)
            e = op8_recompression.EDGE
            seen.append({(a - len(before), n) for a, n in zip(at, names) if len(before) + e <= a < len(before) + 35 - e - 2})
        assert seen[0] == seen[1]
    body = rnd.integers(0, 500, 900).astype(np.uint64)
    spans = []
    for shift in (3, 11):
        w = np.concatenate([np.arange(10**6, 10**6 + shift).astype(np.uint64), body])
        at, size = op8_recompression.high_symbols(op8_recompression.symbols(w, np.zeros(len(w), np.int64)), 35, 1120)
        spans.append({(a - shift, n) for a, n in zip(at.tolist(), size.tolist())})
    assert sum(n for _, n in spans[0] & spans[1]) > 900  # more than once over: at several heights


@pytest.mark.parametrize("long_list", [64, 1])
def test_op7(docs, texts, monkeypatch, long_list):
    monkeypatch.setattr(op7_simhash, "LONG_LIST", long_list)
    fp = {}
    for i, t in enumerate(texts):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in fp}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in fp:
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in op7_simhash.near_duplicates(docs).collect()}
    assert got == {i: (fp[i], find(i)) for i in fp}


def test_near_copies_meet(docs, texts):
    got = {r.doc_id: r.component_id for r in op7_simhash.similar_documents(docs).collect()}
    base = len(texts) - 6
    assert {got[base + k] for k in range(5)} == {base} and got[len(texts) - 1] == len(texts) - 1
    assert len({got[i] for i in range(6, 31)}) == 25


def exact_components(texts):
    """Least index reachable over pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets, label = [], list(range(len(texts)))
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    return dict(enumerate(label))


def edited(kind):
    """Near copies: chains of edits, or edits of one base, that is there or not, alone or sharing an edit; most just above or below 0.8."""
    rnd, out = np.random.default_rng(5), []
    words = base = [f"w{i}" for i in range(200)]
    for k in range(70):
        words = list(words if kind == "chain" else base)
        edits = 1 + k % 4 if kind == "chain" else k % 8
        for n, i in enumerate(rnd.integers(0, 200, edits)):
            words[i] = f"x{k // 6}" if kind == "shared" and n == 0 else f"x{k}_{i}"
        out.append(" ".join(words))
    return out[1:] if kind == "absent" else out


@pytest.mark.parametrize("long_list", [64, 3])
@pytest.mark.parametrize("kind", ["chain", "base", "absent", "shared"])
def test_near_copies_are_exact(spark, monkeypatch, kind, long_list):
    """The components of an exact comparison of all pairs, and the same ones if every list is long."""
    monkeypatch.setattr(op7_simhash, "LONG_LIST", long_list)
    t = [*edited(kind), None, "", "one two", "One  two", "one"]
    got = {r.doc_id: r.component_id for r in op7_simhash.similar_documents(spark.createDataFrame(rows(t), SCHEMA)).collect()}
    assert got == exact_components(t)


def test_similar_texts_below_the_threshold_stay(docs, texts):
    got = {r.doc_id: r.component_id for r in op7_simhash.similar_documents(docs).collect()}
    assert got == exact_components(texts)


def library(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def test_tokens_equal_the_librarys():
    from llm.common import text_blocks
    import pyarrow as pa

    t = ["", "a  b", "x \n y", " ", "\n\n", "a\t b  ", "don't 'sup 'll", "<|endoftext|> hi", "日本 語", "é 12 a1b2 .. !", "a\x85b", "  a", "'", "''s", "a×b ÷", "Ā ſt"]
    got = [x for _, d, o in text_blocks(np.arange(len(t)), pa.array(t), 8) for x in tokenizer(default_path()).encode_block(d, o)]
    assert [x.tolist() for x in got] == [x[:-1] for x in library(t, 0)]


def test_simple8b_words():
    rnd = np.random.default_rng(1)
    for v in ([], [1 << 63, 0, (1 << 60) - 1, 1 << 60], rnd.integers(0, 50257, 5000), [0] * 300, [3] * 61 + [70000] * 4):
        v = np.array(v, dtype=np.uint64)
        assert (op5_simple8b.decode_block(*op5_simple8b.encode_block(v), len(v)) == v).all()


def test_op5(docs, texts):
    ids, at, want = library(texts, 2), 0, {}
    for i, x in enumerate(ids):
        want[i] = (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert {r[0]: tuple(r)[1:] for r in op5_simple8b.read_ids(op5_simple8b.write_ids(docs, default_path(), 2)).collect()} == want


def test_op6(docs, texts):
    got = op6_packing.pack(docs, default_path()).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, ids in enumerate(library(texts, 1)):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_op6_deals_few_sequences_of_many_tasks_to_all_groups(spark):
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows(["one small text"] * 32), 32), SCHEMA)
    tokens = Counter()
    for r in op6_packing.pack(d, default_path()).collect():
        tokens[r.sequence_length, r.step_group] += r.length
    for size in {s for s, _ in tokens}:
        assert len({tokens[size, g] for g in range(op6_packing.GROUPS)}) == 1


def test_op3(spark):
    big = "<p>é</p>" * 200
    pages = [(1, "http://a/ b", big), (2, None, big), (9, "http://c", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "WARC/1.1\r\n\r\n" * 100)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, digest string")
    got = sorted(map(tuple, op3_arc_to_warc.read_archives(op3_arc_to_warc.write_archives(df)).drop("record_id").collect()), key=str)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        revisit = h == big and i != 9
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit and i is not None else "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(want, key=str)


def test_op3_revisits_name_their_record(spark):
    """A reader that knows nothing of these files resolves every revisit by WARC-Refers-To; each file begins with warcinfo."""
    import gzip

    big = "<p>x</p>" * 200
    pages = spark.createDataFrame([(1, "http://a/é b", big), (2, None, big), (9, "http://c d", big), (3, "u", "s")], "page_id bigint, url string, html string")
    heads = []
    for r in op3_arc_to_warc.write_archives(pages.repartition(2)).collect():
        fs, p = op3_arc_to_warc.open_fs(r.path)
        with fs.open_input_stream(p) as raw, gzip.open(raw) as f:
            own = [h for h, _ in op3_arc_to_warc.read_warc(f)]
        assert own[0]["warc-type"] == "warcinfo"
        heads += own[1:]
    by_id = {h["warc-record-id"]: h for h in heads}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 2
    for h in revisits:
        to = by_id[h["warc-refers-to"]]
        assert (to["x-source-row"], to["warc-target-uri"], to["warc-date"], to["warc-type"]) == ("9", h["warc-refers-to-target-uri"], h["warc-refers-to-date"], "response")


@pytest.mark.parametrize("version", [1, 2])
def test_arc(version):
    bodies = [("http://x", b"HTTP/1.1 200 OK\r\n\r\n" + b"filedesc://no 1 2 3 4\n" * 3), ("http://y", b"")]
    data = op3_arc_to_warc.write_arc(version, bodies)
    assert [(r.fields["url"], r.body) for r in op3_arc_to_warc.read_arc(io.BytesIO(data))] == bodies
    with pytest.raises(op3_arc_to_warc.ArcError):
        list(op3_arc_to_warc.read_arc(io.BytesIO(data[:-30])))


def test_op1_prunes():
    """Vectors whose segments are nearly constant: few pairs get an exact product, and the best are those of all pairs."""
    rng = np.random.default_rng(5)
    v = np.repeat(rng.integers(-60, 60, (3000, 8)), 8, axis=1) + rng.integers(-1, 2, (3000, 64))
    ids = rng.permutation(3000)
    seen: dict = {}
    best, got, count = op1_segment_topk.block_topk(ids[::20], v[::20], ids, v, 20, seen=seen)
    assert seen["exact"] < 0.5 * 150 * 3000
    for i, (q, x) in enumerate(zip(ids[::20].tolist(), v[::20], strict=True)):
        want = sorted((-int(s), int(c)) for s, c in zip(v @ x, ids, strict=True) if c != q)[:20]
        assert [(-int(s), int(c)) for s, c in zip(best[i], got[i], strict=True)] == want and count[i] == 20


def test_op1(spark):
    rnd = np.random.default_rng(3)
    v = rnd.integers(-3, 4, (300, 20)).astype(float) / 7
    table = [(i, x.tolist(), "c") for i, x in enumerate(v)] + [(900, None, "c"), (901, [float("nan")] * 20, "c"), (902, [None] * 20, "c"), (903, [1.0], "c"), (None, v[0].tolist(), "c"), (920, [0.5, 1.0], "c"), (921, [1.0, 1.0], "c"), (20, v[20].tolist(), "d")]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, v string")
    iv = op1_segment_topk.integer_vectors(df, "vec_id", "embedding")
    got = sorted(map(tuple, op1_segment_topk.topk(iv, iv.filter("id % 20 = 0"), 20, stripe=64, query_block=4).collect()))
    n = np.floor(64 * v).astype(np.int64)
    # a repeated row: one query, two candidates; vectors of another length meet each other alone
    want = [(q, k + 1, c, s) for q in range(0, 300, 20) for k, (s, c) in enumerate(sorted(((int(n[q] @ n[c]), c) for c in [*range(300), 20] if c != q), key=lambda t: (-t[0], t[1]))[:20])]
    assert got == sorted([*want, (920, 1, 921, 32 * 64 + 64 * 64)])


def test_op4(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    item = rnd.choices(vocab, k=40)
    edited = [w if i % 9 else "changed" for i, w in enumerate(item)]
    noise = lambda k: rnd.choices(vocab, k=k)
    texts = [" ".join(noise(50) + item + noise(50)), " ".join(noise(30) + edited + noise(5)).upper(), " ".join(noise(200)), " ".join(noise(20) + item[:9] + noise(20)), None, ""]
    items = spark.createDataFrame([(7, " ".join(item), 1), (8, None, 1), (9, "", 1), (10, "tiny item", 1)], "item_id bigint, text string, doc_id int")
    d = spark.createDataFrame(rows([*texts, "a tiny, item here, and a tiny item there"]), SCHEMA)
    got = {(r.doc_id, r.item_id): r for r in op4_decontamination.matches(d, items).collect()}
    assert op4_decontamination.matches(d, items).count() == 3 and got[6, 10].n_seeds == 2 and got[6, 10].first_word == 1
    assert set(got) == {(0, 7), (1, 7), (6, 10)} and got[0, 7].score == 1.0 and got[0, 7].first_word == 50 and got[0, 7].last_word == 89
    assert [r.doc_id for r in op4_decontamination.decontaminate(d, items).orderBy("doc_id").collect()] == [2, 3, 4, 5]


@pytest.mark.parametrize("every", [4.3, 5, 6])
def test_op4_finds_edited_copies_however_many(spark, every):
    """Edited passages with less than half of their item's seeds, in 1, 2 and 30 documents of 1,100 and no whole copy beside them."""
    items = [[f"i{k}w{n}" for n in range(40)] for k in range(3)]
    edit = lambda w: [x if int(i % every) else "changed" for i, x in enumerate(w)]
    held = [0, 1, 1, *[2] * 30]
    texts = [f"before {n} " + " ".join(edit(items[k])) + " after" for n, k in enumerate(held)] + [f"filler {n}" for n in range(1_067)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    got = op4_decontamination.matches(spark.createDataFrame(rows(texts), SCHEMA), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == list(enumerate(held))


@pytest.mark.parametrize("more", [0, 1_100])
def test_pipeline_decontaminates_tables_of_any_size(spark, tmp_path, more):
    """An edited copy in one document goes, in a table of three rows as in a larger one."""
    import corpus_pipeline as c

    item = [f"leak{n}" for n in range(40)]
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["clean text", "pre " + " ".join(x if i % 5 else "changed" for i, x in enumerate(item)) + " post", "other text", *[f"filler {n}" for n in range(more)]]
    left = c.benchmark_decontamination(spark, spark.createDataFrame(rows(texts), SCHEMA), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [0, *range(2, 3 + more)]


def test_alignment_is_smith_waterman():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        a, b = rnd.integers(0, 4, rnd.integers(1, 12)), rnd.integers(0, 4, rnd.integers(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert op4_decontamination.align(a, b)[0] == h.max()


def test_op9_wrapped_notices(spark):
    """Notices wrapped over lines are found by their windows of words, with the rows of the SQL; their words far apart are not."""
    def wrap(words, n, gap=" "):
        return "\n".join(gap.join(words[i : i + n]) for i in range(0, len(words), n))

    texts = [f"Before.\n{wrap(t.upper().split(), n)}\nafter it" for _, t in op9_licenses.TEMPLATES for n in (3, 8, 60)]
    labels = [label for label, _ in op9_licenses.TEMPLATES for _ in (3, 8, 60)]
    mit = next(t for label, t in op9_licenses.TEMPLATES if label == "mit").split()
    far = "\n".join(w + " x y z" for w in mit)
    df = spark.createDataFrame(rows([*texts, far, None, "", "\n\n"]), SCHEMA)
    got = {r.doc_id: r for r in op9_licenses.scan(df).collect()}
    for i, label in enumerate(labels):
        assert label in got[i].labels.split(","), (i, label)
    assert [got[len(texts) + i].labels for i in range(4)] == [""] * 4 and got[len(texts)].score == 0.0
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(map(tuple, con.sql(op9_licenses.SQL).fetchall())) == sorted(map(tuple, got.values()))


def test_op9(spark):
    t = ["Released under the MIT License.", "x\nThis work is licensed under the GNU General Public License, version 3.\ny", None, "", "cc by cc-BY 4", "a license", "Licensed under CC BY-NC 4.0."]
    got = {r.doc_id: tuple(r)[1:] for r in op9_licenses.scan(spark.createDataFrame(rows(t), SCHEMA)).collect()}
    assert got[0] == (5, 1, 3, 3, "mit", "mit", 1.0) and got[1][1:6] == (1, 7, 7, "gpl", "gpl")
    assert got[2] == got[3] == (0, 0, None, None, "", "", 0.0) and got[4][:5] == (5, 2, 0, 2, "cc-by") and got[5][:5] == (2, 0, None, None, "")
    assert got[6][4:6] == ("cc-by", "cc-by,cc-by-nc")
    own = {r.doc_id: (r.n_base, r.base_labels) for r in op9_licenses.scan(spark.createDataFrame(rows(["put in the Public Domain", "public"]), SCHEMA), phrases={"public domain": "pd"}).collect()}
    assert own == {0: (1, "pd"), 1: (0, "")}


def test_op2_one_string_many_times(monkeypatch):
    """More context than a piece: strings pass through pieces and the first of each kind stays."""
    monkeypatch.setattr(op2_suffix_dedup, "PIECE", 300)
    rnd = np.random.default_rng(6)
    for kinds in (1, 3, 40, 400):
        strings = rnd.integers(0, 3, (kinds, 20)).astype(np.uint8)
        which = rnd.integers(0, kinds, 400)
        later = np.sort(np.concatenate(list(op2_suffix_dedup.later_in_pieces(strings[which].ravel(), np.arange(400) * 20, 20))))
        seen, want = set(), []
        for i, k in enumerate(which):
            if strings[k].tobytes() in seen:
                want.append(i)
            seen.add(strings[k].tobytes())
        assert later.tolist() == want


def test_op2_one_run_that_repeats_itself(spark):
    """Periods whose hash no other run has: a line of dashes, short and long periods, in texts of their own."""
    rnd = random.Random(3)
    t = ["abc" * 60, "".join(rnd.choices("stuv", k=200)) + "-" * 120 + "".join(rnd.choices("stuv", k=200))]
    for k in range(1, 90, 4):
        period = "".join(rnd.choices("abcdefghijkl", k=k))
        t.append("".join(rnd.choices("stuv", k=k)) + (period * 400)[: 99 + 3 * k] + "".join(rnd.choices("stuv", k=50)))
    got = {r[0]: tuple(r)[1:] for r in op2_suffix_dedup.dedup_bytes(spark.createDataFrame(rows(t), SCHEMA)).collect()}
    assert got == bytes_oracle(t, 100)


def test_op2_long_runs(spark):
    """Runs over a block: of one byte, of a period, and a long text twice."""
    rnd = random.Random(8)
    long = "".join(rnd.choices("abcdefghij ", k=300_000))
    t = ["a" * 400_000, "xyz" * 1000, "q" + "a" * 150, long, "zz" + long[1000:290_000]]
    got = {r[0]: tuple(r)[1:] for r in op2_suffix_dedup.dedup_bytes(spark.createDataFrame(rows(t), SCHEMA)).collect()}
    assert got == bytes_oracle(t, 100)


def test_very_long_text_of_tokens():
    """A text of many pieces gives the library's ids."""
    rnd = random.Random(2)
    t = " ".join("".join(rnd.choices("abcdé日'", k=rnd.randint(1, 8))) for _ in range(60_000))
    data = np.frombuffer(t.encode(), np.uint8)
    assert tokenizer(default_path()).encode_block(data, np.array([0, len(data)]))[0].tolist() == library([t], 0)[0][:-1]


def test_toxicity_stage_leaves_columns_of_its_name(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.createDataFrame([(2, "fine words here", 9.5), (3, "you idiot " * 20, 1.0), (None, None, None)], "doc_id bigint, text string, toxicity double")
    assert sorted(map(tuple, c.toxicity(spark, d, str(tmp_path)).collect()), key=str) == sorted([(2, "fine words here", 9.5), (None, None, None)], key=str)


def test_op10_held_out_accuracy(spark):
    rnd = random.Random(4)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("at", "in", "or", "us", "el")]
    docs, labels = [], []
    for i in range(600):
        w = rnd.choices(vocab, k=40)
        bad = i % 8 == 0
        for _ in range(3 if bad else 0):
            w[rnd.randrange(40)] = rnd.choice(["grumpzik", "grumpzor", "vexlo"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    d = spark.createDataFrame([*docs, (None, "vexlo"), (601, None), (602, "")], "doc_id bigint, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    model = op10_toxicity.fit_tables(d, lab)
    got = {r.doc_id: r.toxicity for r in op10_toxicity.scored(d, model).collect()}
    held = [i for i in range(600) if op10_toxicity.crc_mod4(i) == 2]
    assert sum((got[i] >= 0.3) == (i % 8 == 0) for i in held) >= 0.97 * len(held)
    assert got[None] >= 0.3 and got[601] == got[602] < 0.3


@pytest.mark.parametrize("f", [
    lambda d: op2_suffix_dedup.dedup_bytes(d), lambda d: op8_recompression.dedup_substrings(d), lambda d: op7_simhash.near_duplicates(d), lambda d: op7_simhash.similar_documents(d),
    lambda d: op5_simple8b.read_ids(op5_simple8b.write_ids(d, default_path(), 2)), lambda d: op9_licenses.scan(d),
])
def test_odd_ids_and_empty_tables(spark, texts, f):
    d = odd(spark, texts)
    got = f(d)
    assert sorted((r[0] is None, r[0]) for r in got.select("doc_id").collect()) == sorted((r[0] is None, r[0]) for r in d.select("doc_id").collect())
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id bigint, text string")
    assert op6_packing.pack(none, default_path()).count() == 0 and op4_decontamination.matches(none, items).count() == 0
    v = spark.createDataFrame([], "id bigint, v array<bigint>")
    assert op1_segment_topk.topk(v, v, 5).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert op3_arc_to_warc.read_archives(op3_arc_to_warc.write_archives(pages)).count() == 0
    lab = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert op10_toxicity.scored(none, op10_toxicity.fit_tables(none, lab)).count() == 0


def test_pipeline_stages_take_effect(spark, texts, tmp_path):
    import corpus_pipeline as c

    item = " ".join(f"leak{i}" for i in range(30))
    t = [*texts, "pre " + item + " post", "you idiot " * 20]
    d = spark.createDataFrame(rows(t), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in c.STAGES:
        docs = c.materialise(stage(spark, docs, str(tmp_path)))
        if name != "packing":
            assert docs.columns == d.columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert len(t) - 1 not in kept[0] and len(kept[0]) == len(t) - 1
    base = len(texts) - 6
    assert base in kept[1] and not {base + k for k in range(1, 5)} & kept[1]
    assert len(t) - 2 in kept[2] and len(t) - 2 not in kept[3] and set(range(7, 31)) <= kept[3] and kept[4] == kept[3]


def few(ids_texts):
    return [(i, t, "en", "s", len(t), 1, "x", 2) for i, t in ids_texts]


def test_pipeline_decides_rows_with_one_id_one_by_one(spark, tmp_path):
    import corpus_pipeline as c

    unique = lambda name: " ".join(f"{name}{n}" for n in range(60))
    a, u, leak = unique("a"), [unique(f"u{k}x") for k in range(3)], unique("leak")
    d = spark.createDataFrame(few([(0, a), (1, a), (1, u[0]), (2, u[1]), (2, u[2])]), SCHEMA)
    near = c.simhash_near_dedup(spark, d, "")
    want = [(0, a), (1, u[0]), (2, u[1]), (2, u[2])]
    assert sorted((r.doc_id, r.text) for r in near.collect()) == want and near.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in c.substring_dedup(spark, near, "").collect()) == want
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.createDataFrame(few([(1, a), (1, "x " + leak)]), SCHEMA)
    assert [r.text for r in c.benchmark_decontamination(spark, d, str(tmp_path)).collect()] == [a]


def test_pipeline_rows_without_an_id_take_part(spark):
    import corpus_pipeline as c

    unique = lambda name: " ".join(f"{name}{n}" for n in range(60))
    a, b = unique("a"), unique("b")
    d = spark.createDataFrame(few([(None, a), (5, a), (None, a), (None, b), (None, b), (7, unique("c"))]), SCHEMA)
    near = c.simhash_near_dedup(spark, d, "")
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == sorted([(5, a), (None, b), (7, unique("c"))], key=str)
    passage = unique("p")
    d = spark.createDataFrame(few([(None, "one " + passage), (None, passage + " two"), (5, passage + " three"), (None, "four")]), SCHEMA)
    left = c.substring_dedup(spark, d, "")
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in left.collect()), key=str) == sorted([(None, "one", 3), (None, "two", 3), (5, "three", 5), (None, "four", 4)], key=str)
    assert left.columns == d.columns


def plain_score(item, text):
    """Smith-Waterman of two lists of words, cell by cell, over the score of the whole item."""
    best, last = 0, [0] * (len(text) + 1)
    for w in item:
        row = [0]
        for j, x in enumerate(text):
            row.append(max(0, last[j] + (2 if w == x else -1), last[j + 1] - 1, row[j] - 1))
        best, last = max(best, *row), row
    return best / (2 * len(item))


def leaky():
    """Items, and texts with passages of them: edited by 10 to 50%, in one document or several, in part, with words lost and put in; of the last items, one edit by 20% only."""
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    items, texts = [rnd.sample(vocab, rnd.randint(20, 50)) for _ in range(12)], []

    def passage(item, share):
        out = []
        for w in item:
            kind = rnd.choice("sssdi") if rnd.random() < share else ""
            out += [f"e{rnd.randrange(10**6)}"] if kind == "s" else [] if kind == "d" else [w, f"e{rnd.randrange(10**6)}"] if kind == "i" else [w]
        return out

    for k, item in enumerate(items):
        for share in (0.1, 0.15, 0.2, 0.25, 0.3, 0.5) if k < 6 else (0.2,):
            p = passage(item, share)
            texts += [rnd.choices(vocab, k=30) + (p if k % 2 else passage(item, share)) + rnd.choices(vocab, k=30) for _ in range(1 + k % 3)]
        texts += [rnd.choices(vocab, k=20) + item[: len(item) // 3], rnd.choices(vocab, k=80)]
    return items, texts


def test_op4_equals_smith_waterman_of_all_pairs(spark):
    items, texts = leaky()
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    d = spark.createDataFrame(rows([" ".join(w) for w in texts]), SCHEMA)
    got = {(r.doc_id, r.item_id): r.score for r in op4_decontamination.matches(d, bench).collect()}
    want = {(i, k): plain_score(w, t) for i, t in enumerate(texts) for k, w in enumerate(items)}
    assert got == {p: x for p, x in want.items() if x >= 0.5} and 40 < len(got) < len(texts)


def test_pipeline_run_equals_plain_python(spark, tmp_path):
    """run() against its five steps in plain Python; only the model's verdicts are given (one text of insults goes)."""
    import corpus_pipeline as c

    rnd = random.Random(3)
    items, leaks = leaky()
    base, shared = [f"b{i}" for i in range(200)], [f"p{i}" for i in range(60)]
    t = [[w if rnd.random() > k / 200 else f"x{k}" for w in base] for k in range(8)]
    t += [[f"n{k}", *shared, f"m{k}"] for k in range(4)] + [shared[5:55], *leaks, ["you", "idiot"] * 20, ["one"], []]
    t = [" ".join(w) for w in t]
    d = spark.createDataFrame(rows(t), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = [i for i, x in enumerate(t) if "idiot" not in x]
    label = exact_components([t[i] for i in ids])
    words = {i: t[i].split() for n, i in enumerate(ids) if label[n] == n}
    count = Counter(tuple(w[p : p + 35]) for w in words.values() for p in range(len(w) - 34))
    want = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - 34) if count[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
        left = [x for p, x in enumerate(w) if p not in gone]
        if (left or not w) and all(plain_score(item, left) < 0.5 for item in items):
            want[i] = " ".join(left)
    pieces = defaultdict(list)
    for r in c.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(want)
    for i, tokens in zip(want, library(want.values(), 1), strict=True):
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(tokens)) and r.ids_crc32 == zlib.crc32(np.array(tokens[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(tokens)


def test_op7_rare_shingles_pair_by_prefixes():
    """Texts that share rare shingles, and differ in more, make no pairs for each two of them; those that link and share a rare one all meet."""
    import pyarrow as pa
    import zstandard

    rnd = random.Random(4)
    w = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    shared, base = w(40), w(80)
    t = [" ".join(shared + w(60)) for _ in range(60)]
    for _ in range(60):
        x = list(base)
        x[rnd.randrange(40)] = w(1)[0]
        t.append(" ".join(x + w(rnd.randint(0, 12))))
    sets = [np.unique(op7_simhash.shingle_hashes(x.encode(), 5)) for x in t]
    n, z = len(t), [zstandard.ZstdCompressor().compress(x.encode()) for x in t]
    count = Counter(np.concatenate(sets).tolist())
    rare = [{h for h in x.tolist() if count[h] <= op7_simhash.LONG_LIST} for x in sets]
    by_text = lambda *names: list(op7_simhash._rare_of_texts(op7_simhash._rare(op7_simhash.LONG_LIST, 1)(op7_simhash._postings(5, 1)(iter([pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(z)], names=["node", "z"])])))))
    out = pa.Table.from_batches(by_text()).to_pylist()
    assert {r["node"]: set(np.frombuffer(r["rare"], np.uint64).tolist()) for r in out} == {i: x for i, x in enumerate(rare) if x}
    rows_in = pa.RecordBatch.from_pylist([{"node": r["node"], "label": r["node"], "n": len(sets[r["node"]]), "rare": r["rare"]} for r in out], schema=pa.schema([("node", pa.int64()), ("label", pa.int64()), ("n", pa.int32()), ("rare", pa.binary())]))
    made = list(op7_simhash._met(0.8)(op7_simhash._prefixes(0.8, 1)(iter([rows_in]))))
    got = {tuple(sorted(r.values())) for b in made for r in b.to_pylist()}
    jaccard = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if rare[a] & rare[b] and jaccard(a, b) >= 0.8}
    assert want and want <= got and not [p for p in got if p[1] < 60]
