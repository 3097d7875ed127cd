"""Codec, splits, source, ordering and verification, with the edge inputs that a record sorter meets."""

import io
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keytide.functions.keys import bias, unbias
from keytide.operators import ordering, verify
from keytide.sources import codec, splits
from keytide.sources.datagen import generate
from keytide.sources.recordfile import concat_parts, list_record_files, register

EDGE_KEYS = [0, 1, 255, 256, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]


def raw(records):
    return b"".join(codec.encode(bias(k), p) for k, p in records)


def decode(data, **kw):
    out = []
    for b in codec.decode_stream(io.BytesIO(data), 0, len(data), **kw):
        out += [(unbias(r["key"]), r["payload"]) for r in b.to_pylist()]
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, (1 << 64) - 1), st.binary(max_size=40)), max_size=30), st.integers(1, 50))
def test_codec_round_trip(records, block):
    assert decode(raw(records), block_bytes=block) == records
    batch = pa.RecordBatch.from_pylist([{"key": bias(k), "payload": p} for k, p in records], schema=codec.SCHEMA)
    assert codec.encode_batch(batch) == raw(records)


def test_truncated_and_big_records():
    data = raw([(5, b"abc"), (6, b"x" * 9_000_000)])
    assert len(decode(data, block_bytes=1000)) == 2
    for cut in (5, 14):
        with pytest.raises(codec.TruncatedRecord):
            decode(data[: 15 + cut])
        assert decode(data[: 15 + cut], strict=False) == [(5, b"abc")]
    assert decode(b"") == []


@pytest.mark.parametrize("parts", [1, 2, 3, 7, 16])
def test_splits_cover_and_align(parts):
    rnd = random.Random(1)
    records = [(rnd.getrandbits(64), rnd.randbytes(rnd.randint(8, 60))) for _ in range(400)]
    data = raw(records)
    whole, _ = codec.record_offsets(data, len(data))
    legal = {*whole, len(data)}
    for cuts in (splits.exact_splits(io.BytesIO(data), len(data), parts), splits.sampled_splits(io.BytesIO(data), len(data), parts, 60, window=64, min_payload=8)):
        assert cuts[0] == 0 and cuts[-1] == len(data) and len(cuts) == parts + 1
        assert cuts == sorted(cuts) and set(cuts) <= legal


def test_sampled_splits_of_runs_that_begin_beside_a_record(spark, tmp_path):
    """A byte before each of these records, a plausible one begins that ends where a true one does: 11 + 37 + 256 * 100 is 229 records of 112 bytes."""
    data = raw([(37 << 56 | i, b"x" * 100) for i in range(3000)])
    for parts in (4, 9):
        cuts = splits.sampled_splits(io.BytesIO(data), len(data), parts, 1 << 20)
        assert len(cuts) == parts + 1 and len(set(cuts)) > 3 and all(c % 112 == 0 for c in cuts)
    register(spark)
    (tmp_path / "f.bin").write_bytes(data)
    assert spark.read.format("recordfile").option("split_bytes", 50_000).load(str(tmp_path / "f.bin")).count() == 3000


def test_exact_splits_ignore_payloads_that_look_like_records():
    inner = raw([(i, b"y" * 8) for i in range(50)])
    data = raw([(i, inner) for i in range(20)])
    starts, _ = codec.record_offsets(data, len(data))
    assert set(splits.exact_splits(io.BytesIO(data), len(data), 7)) <= {*starts, len(data)}


def test_few_records_for_many_parts():
    data = raw([(1, b"a"), (2, b"b"), (3, b"c")])
    cuts = splits.exact_splits(io.BytesIO(data), len(data), 8)
    assert sum(len(codec.record_offsets(data[a:b], b - a)[0]) for a, b in zip(cuts, cuts[1:])) == 3


@pytest.mark.parametrize("mode", ["exact", "sampled"])
def test_source_sort_write_concat(spark, tmp_path, mode):
    register(spark)
    rnd = random.Random(2)
    records = [(k, b"edge") for k in EDGE_KEYS] + [(rnd.getrandbits(64), rnd.randbytes(rnd.randint(0, 50))) for _ in range(500)]
    rnd.shuffle(records)
    src = tmp_path / "in.bin"
    src.write_bytes(raw(records))
    df = spark.read.format("recordfile").option("split_bytes", 2000).option("split_mode", mode).option("max_payload", 50).load(str(src))
    assert sorted((unbias(r.key), bytes(r.payload)) for r in df.collect()) == sorted(records)
    out = str(tmp_path / "out")
    ordering.range_sort(df, 3, "key", "payload").write.format("recordfile").mode("overwrite").option("path", out).save()
    single = tmp_path / "one.bin"
    concat_parts(out, str(single))
    assert decode(single.read_bytes()) == sorted(records)
    back = spark.read.format("recordfile").load(out)
    assert verify.verify_order(back, expected_count=len(records)).ok and verify.same_multiset(df, back)
    assert len(list_record_files(out)) == 3


def test_empty_source_and_missing_path(spark, tmp_path):
    register(spark)
    (tmp_path / "e.bin").write_bytes(b"")
    df = spark.read.format("recordfile").load(str(tmp_path / "e.bin"))
    assert df.count() == 0 and verify.verify_order(df, expected_count=0).ok
    with pytest.raises(Exception):  # noqa: B017
        spark.read.format("recordfile").load(str(tmp_path / "none")).count()


def test_sampled_cuts_that_are_wrong_are_noticed(spark, tmp_path):
    """Payloads made of records mislead sampled cuts; the task before a wrong cut fails, and exact cuts read the file."""
    register(spark)
    inner = raw([(i, b"y" * 8) for i in range(400)])
    records = [(i, inner) for i in range(20)]
    (tmp_path / "f.bin").write_bytes(raw(records))
    read = lambda **o: spark.read.format("recordfile").options(split_bytes=20_000, **o).load(str(tmp_path / "f.bin"))
    with pytest.raises(Exception, match="split_mode=exact"):
        read().count()
    with pytest.raises(Exception, match="split_mode=exact"):
        read(strict="false").count()
    assert sorted(unbias(r.key) for r in read(split_mode="exact").collect()) == list(range(20))


def test_keys_alone_pass_over_payloads():
    class Counting(io.BytesIO):
        n = 0

        def read(self, size=-1):
            out = super().read(size)
            self.n += len(out)
            return out

    data = raw([(k, b"x" * 1_000_000) for k in (9, 3, 7)] + [(5, b"")])
    f = Counting(data)
    keys = [unbias(k.as_py()) for b in codec.decode_stream(f, 0, len(data), keys_only=True) for k in b.column(0)]
    assert keys == [9, 3, 7, 5] and f.n < len(data) // 5
    small = raw([(k, b"y" * (k % 50)) for k in range(9000)])
    assert [unbias(k.as_py()) for b in codec.decode_stream(io.BytesIO(small), 0, len(small), keys_only=True) for k in b.column(0)] == list(range(9000))
    with pytest.raises(codec.TruncatedRecord):
        list(codec.decode_stream(io.BytesIO(small[:-1]), 0, len(small) - 1, keys_only=True))
    assert sum(b.num_rows for b in codec.decode_stream(io.BytesIO(small[:-1]), 0, len(small) - 1, keys_only=True, strict=False)) == 8999


def test_publish_keeps_the_old_files_until_the_new_ones_count(spark, tmp_path):
    from keytide.sources.recordfile import _Writer

    out = str(tmp_path / "o")
    first = spark.createDataFrame([(1, b"old")], "key bigint, payload binary")
    register(spark)
    first.write.format("recordfile").mode("overwrite").option("path", out).save()
    w = _Writer(out, True)
    (tmp_path / "o" / "part-000000-stray.bin").write_bytes(raw([(2, b"half")]))  # moved in by a writer that died before its manifest
    assert [r.payload for r in spark.read.format("recordfile").load(out).collect()] == [b"old"]
    w.commit([])
    assert spark.read.format("recordfile").load(out).count() == 0


def test_split_files_have_equal_shares_and_the_rest_last(spark, tmp_path):
    register(spark)
    for n, k in ((10, 4), (10_003, 4), (2, 4), (0, 1)):
        out = str(tmp_path / f"g{n}")
        generate(spark, n, 16, splits=k).select("key", "payload").write.format("recordfile").mode("overwrite").option("path", out).save()
        assert [len(decode(open(p, "rb").read())) for p, _ in list_record_files(out)] == [n // k] * (k - 1) + [n // k + n % k]


def test_running_total_and_clamp(spark):
    from pyspark.sql import functions as F

    from keytide.functions.keys import clamp

    df = spark.range(1000).select("id", (F.col("id") % 7).alias("w")).repartition(5)
    got = {r.id: r.upto for r in ordering.running_total(df, 4, "w", "id").collect()}
    assert got == {i: sum(j % 7 for j in range(i + 1)) for i in range(1000)}
    assert [r[0] for r in spark.range(5).select(clamp(F.col("id"), F.lit(1), F.lit(3))).collect()] == [1, 1, 2, 3, 3]


def test_verify_reports_the_first_violation(spark):
    def part(keys, n):
        return spark.createDataFrame([(k,) for k in keys], "key bigint").coalesce(1) if n == 1 else spark.createDataFrame([(k,) for k in keys], "key bigint").repartition(1)

    inside = part([1, 2, 9, 3, 4], 1)
    r = verify.verify_order(inside, unsigned=False)
    assert (r.ok, r.index, r.previous, r.current, r.violations) == (False, 3, 9, 3, 1)
    across = part([1, 2, 9], 1).union(part([3, 4], 1))
    r = verify.verify_order(across, unsigned=False)
    assert (r.ok, r.index, r.previous, r.current) == (False, 3, 9, 3)
    assert verify.verify_order(part([1, 1, 2], 1), expected_count=4).message == "Count mismatch"


def test_multiset_sees_a_changed_payload(spark):
    a = spark.createDataFrame([(1, b"aa"), (2, b"bb")], "key bigint, payload binary")
    b = spark.createDataFrame([(2, b"bb"), (1, b"ab")], "key bigint, payload binary")
    assert verify.same_multiset(a, a.orderBy("key")) and not verify.same_multiset(a, b)


def test_generate_is_the_same_for_any_partitioning(spark):
    rows = [sorted(map(tuple, generate(spark, 103, 16, seed=3, splits=s).drop("split").collect())) for s in (1, 4)]
    assert rows[0] == rows[1] and all(8 <= len(r[2]) <= 16 for r in rows[0])
    assert [r.n for r in generate(spark, 10, 16, splits=4).groupBy("split").count().withColumnRenamed("count", "n").orderBy("split").collect()] == [2, 2, 2, 4]


def test_skewed_and_equal_keys_keep_all_rows(spark):
    df = spark.range(3000).selectExpr("cast(id % 3 = 0 as bigint) as key", "id")
    ranked = ordering.global_rank(df, 4, "key", "id")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 3001))


def test_merges_agree(spark):
    runs = [spark.range(i, 50, 4).withColumnRenamed("id", "key") for i in range(4)]
    want = list(range(50))
    assert [r.key for r in ordering.merge(runs).collect()] == want == [r.key for r in ordering.tree_merge(runs).collect()]
    assert [r.key for r in ordering.tree_merge(runs[:3]).collect()] == [x for x in want if x % 4 != 3]
    with pytest.raises(ValueError):
        ordering.merge([])


def test_stream_ingest(spark, tmp_path):
    from keytide.streaming.ingest import ingest, read_ordered

    src, dst, ck = (str(tmp_path / x) for x in ("s", "d", "c"))
    for seed in (1, 2):
        generate(spark, 60, 16, seed=seed).select("key", "payload").write.mode("append").parquet(src)
        ingest(spark, src, dst, ck).awaitTermination()
    keys = [r.key for r in read_ordered(spark, dst).collect()]
    assert len(keys) == 120 and keys == sorted(keys)


def test_cli(spark, tmp_path):
    from keytide.cli import main

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert main(["gen", a, "200", "16", "--splits", "3"], spark) == 0
    assert main(["sort", a, b, "--parts", "3", "--expect", "200", "--single", str(tmp_path / "o.bin")], spark) == 0
    assert main(["verify", b, "--expect", "201"], spark) == 1
    assert main(["verify", a], spark) == 1
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "f.bin").write_bytes(raw([(3, b"abc"), (1, b"d" * 50)])[:-1])
    assert main(["sort", str(tmp_path / "cut"), str(tmp_path / "c"), "--lenient", "--expect", "1"], spark) == 0


def test_cut_off_records_are_counted(spark, tmp_path):
    register(spark)
    body = raw([(i, b"x" * (i % 40)) for i in range(5000)])
    (tmp_path / "a.bin").write_bytes(body)
    (tmp_path / "b.bin").write_bytes(body[:-1])
    t = spark.read.format("recordfile").options(split_bytes=30_000, tails="true").load(str(tmp_path)).groupBy("path").agg({"records": "sum", "dropped": "sum"})
    assert sorted((r["path"][-5:], r["sum(records)"], r["sum(dropped)"]) for r in t.collect()) == [("a.bin", 5000, 0), ("b.bin", 4999, 1)]


def test_plan_metrics(spark):
    from keytide.operators.metrics import last_execution, plan_metrics

    mark = last_execution(spark)
    spark.range(1000, numPartitions=3).selectExpr("id % 7 as k").sort("k").write.format("noop").mode("overwrite").save()
    got = {(r.operator, r.metric): r.value for r in plan_metrics(spark, mark).collect()}
    assert any(o.startswith("Sort") and m == "sort time" for o, m in got) and any(m == "shuffle records written" and v == "1,000" for (o, m), v in got.items())


def test_sweep(spark, tmp_path):
    import json

    from keytide.cli import main

    assert main(["sweep", str(tmp_path), "--sizes", "300", "--workers", "1,2"], spark) == 0
    found = json.loads((tmp_path / "sweep.json").read_text())
    assert [(r["variant"], r["workers"]) for r in found] == [("300x16", 1), ("300x16", 2)] and found[0]["speedup"] == 1.0
