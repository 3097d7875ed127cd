"""One query for each operator family over the driver's tables, and its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytide.functions.keys import BIAS, bias_decimal, clamp, md5_u64, payload_bytes, record_bytes, unbias_decimal
from keytide.operators import metrics, ordering, verify
from keytide.sources.codec import encode_batch, record_offsets, to_batch
from keytide.sources.datagen import generate, payload_for
from keytide.sources.recordfile import concat_parts, register
from keytide.workspace import shared_folder

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_U = "('0x'||substr(md5(doc_id::varchar),1,16))::UBIGINT"
_K = f"({_U}::HUGEINT - {BIAS})::BIGINT"
_RUN_BYTES, _SPLITS, _GEN_N, _GEN_SPLITS = 1 << 18, 4, 1000, 3
_FILE_SPLIT, _FILE_N, _FILE_SPLITS = 100_000, 10_003, 4


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").filter("doc_id is not null")
    return d.select("doc_id", bias_decimal(md5_u64(F.col("doc_id"))).alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def decode_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("doc_id", "key", unbias_decimal(F.col("key")).cast("string").alias("key_u64"))


def record_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("doc_id", payload_bytes(F.col("payload")).alias("len"), record_bytes(F.col("payload")).alias("size"))


def _through_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = encode_batch(b)
        starts, stop = record_offsets(raw, len(raw))
        yield to_batch(raw, starts, stop)


def record_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    out = _records(spark, sf).select("key", "payload").mapInArrow(_through_bytes, "key bigint, payload binary")
    return out.select("key", payload_bytes(F.col("payload")).alias("len"), F.md5("payload").alias("payload_md5"))


def sort_rank_u64(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.global_rank(_records(spark, sf).select("doc_id", "key"), _parts(spark), "key", "doc_id")


def sort_rank_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.global_rank(_t(spark, sf, "lineitem").select(*LINE), _parts(spark), *LINE)


def range_partition_sort(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed-partition sort; ranks are the places at which its rows stand, partition after partition."""
    t = ordering.range_sort(_t(spark, sf, "orders").select("o_custkey", "o_orderkey"), _parts(spark), "o_custkey", "o_orderkey")
    return ordering.stored_rank(t)


def run_local_rank(spark: SparkSession, sf: str) -> DataFrame:
    d = _records(spark, sf).select("doc_id", "key")
    return ordering.run_sort(d, F.floor(F.col("doc_id") / 128).cast("bigint"), "key", "doc_id")


def _positions(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Start and end byte of every event record in event_id order, without a single-partition window."""
    e = _t(spark, sf, "events").select("event_id", record_bytes(F.coalesce("props", F.lit(""))).alias("size"))
    total = e.agg(F.sum("size")).first()[0] or 0
    return ordering.running_total(e, _parts(spark), "size", "event_id", total="end_byte"), total


def assign_runs(spark: SparkSession, sf: str) -> DataFrame:
    p, _ = _positions(spark, sf)
    r = p.withColumn("run_id", ordering.run_of(F.col("end_byte"), _RUN_BYTES))
    return r.groupBy("run_id").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


def assign_splits(spark: SparkSession, sf: str) -> DataFrame:
    p, total = _positions(spark, sf)
    s = p.withColumn("split", ordering.split_of(F.col("end_byte") - F.col("size"), F.lit(total), _SPLITS))
    return s.groupBy("split").agg(F.count("*").alias("n"), F.sum("size").cast("bigint").alias("bytes"))


def _slices(spark: SparkSession, sf: str, k: int) -> list[DataFrame]:
    d = _records(spark, sf).select("doc_id", "key")
    return [d.filter(F.pmod("doc_id", F.lit(k)) == i) for i in range(k)]


def kway_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks here and below are the places at which the merged rows stand."""
    return ordering.stored_rank(ordering.merge(_slices(spark, sf, 5), "key", "doc_id"))


def tree_merge(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.stored_rank(ordering.tree_merge(_slices(spark, sf, 5), "key", "doc_id"))


def merge_two_stable(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"))
    a, b = e.filter(F.pmod("pos", F.lit(2)) == 0), e.filter(F.pmod("pos", F.lit(2)) == 1)
    return ordering.stored_rank(ordering.merge_two_stable(a, b, "pos"))


def _target(spark: SparkSession, kind: str) -> str:
    register(spark)
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.select("key", "payload").write.format("recordfile").mode(mode).option("path", path).save()
    return path


def _read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    r = spark.read.format("recordfile")
    for k, v in options.items():
        r = r.option(k, str(v).lower() if isinstance(v, bool) else v)
    return r.load(path)


def _seen() -> list[Column]:
    return [payload_bytes(F.col("payload")).alias("len"), F.md5("payload").alias("payload_md5")]


def recordfile_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as record files, written, cut into ranges and read back."""
    return _read(spark, _write(_records(spark, sf), _target(spark, "scan")), split_bytes=1 << 16).select("key", *_seen())


def recordfile_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys alone, payloads passed over."""
    return _read(spark, _write(_records(spark, sf), _target(spark, "keys")), keys_only=True)


def recordfile_append(spark: SparkSession, sf: str) -> DataFrame:
    """Even and odd documents written one after the other into one folder."""
    d, path = _records(spark, sf), _target(spark, "append")
    for k in (0, 1):
        _write(d.filter(F.pmod("doc_id", F.lit(2)) == k), path, "append")
    return _read(spark, path).groupBy("key").agg(F.count("*").alias("n"), F.max(payload_bytes(F.col("payload"))).alias("len"))


def _one_file(spark: SparkSession, df: DataFrame, *by: str) -> str:
    """One file of all records in order."""
    parts, path = _target(spark, "parts"), _target(spark, "file") + ".bin"
    _write(ordering.range_sort(df, _parts(spark), *by), parts)
    concat_parts(parts, path)
    return path


def recordfile_splits(spark: SparkSession, sf: str) -> DataFrame:
    """One file in document order, cut in ranges of about _FILE_SPLIT bytes: records and bytes of each range, by exact cuts."""
    r = _read(spark, _one_file(spark, _records(spark, sf), "doc_id"), split_bytes=_FILE_SPLIT, split_mode="exact")
    r = r.groupBy(F.spark_partition_id().alias("range")).agg(F.count("*").alias("n"), F.sum(record_bytes(F.col("payload"))).cast("bigint").alias("bytes"))
    return ordering.stored_rank(ordering.range_sort(r, 1, "range"), "split").select("split", "n", "bytes")


def recordfile_sampled_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The same file by sampled cuts, each proved by the task before it; every record comes once, in file order."""
    r = _read(spark, _one_file(spark, _records(spark, sf), "doc_id"), split_bytes=_FILE_SPLIT)
    return ordering.stored_rank(r).select("rank", "key", *_seen())


def recordfile_sort_publish(spark: SparkSession, sf: str) -> DataFrame:
    """Files read, sorted by unsigned key, published over an older result and joined into one file; ranks are places in that file."""
    rows, out = _read(spark, _write(_records(spark, sf), _target(spark, "in")), split_bytes=1 << 16), _target(spark, "sorted")
    _write(rows.limit(0), out)
    _write(ordering.range_sort(rows, _parts(spark), "key", "payload"), out)
    one = _target(spark, "single") + ".bin"
    concat_parts(out, one)
    return ordering.stored_rank(_read(spark, one, split_bytes=1 << 18)).select("rank", "key", *_seen())


def recordfile_verify(spark: SparkSession, sf: str) -> DataFrame:
    """The order check over a single sorted file, read by many tasks."""
    one = _one_file(spark, _records(spark, sf), "key", "payload")
    return _order_row(spark, verify.verify_order(_read(spark, one, keys_only=True, split_bytes=_FILE_SPLIT)))


def sorted_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of at most about _RUN_BYTES, each sorted and written to record files of its own; ranks are places in the run's file."""
    r = _records(spark, sf).withColumn("size", record_bytes(F.col("payload")))
    r = ordering.running_total(r, _parts(spark), "size", "doc_id").withColumn("run_id", ordering.run_of(F.col("upto"), _RUN_BYTES))
    runs = r.select("run_id").distinct().count()
    path = _target(spark, "runs")
    # a partition a run, in run order, so that part files are runs
    placed = r.repartitionByRange(max(1, runs), "run_id").sortWithinPartitions("run_id", "key")
    _write(placed, path)
    return ordering.stored_rank(_read(spark, path, split_bytes=1 << 40).select("key"), "place")


def key_clamp(spark: SparkSession, sf: str) -> DataFrame:
    """Splits of the customer keys clamped to the range that the orders have."""
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return o.select("o_orderkey", clamp(F.col("o_custkey"), F.lit(100), F.lit(1000)).alias("clamped"))


def generated_file(spark: SparkSession, sf: str) -> DataFrame:
    """Generated records as files, one a split: records of each, the last with what is left over."""
    rows = _write(generate(spark, _FILE_N, 16, splits=_FILE_SPLITS), _target(spark, "gen"))
    r = _read(spark, rows, split_bytes=1 << 40).groupBy(F.spark_partition_id().alias("range")).agg(F.count("*").alias("n"))
    return ordering.stored_rank(ordering.range_sort(r, 1, "range"), "file").select("file", "n")


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a stream of new files, bucketed by key range, read back in order."""
    from keytide.streaming.ingest import ingest, read_ordered

    source, target = _target(spark, "stream"), _target(spark, "buckets")
    _records(spark, sf).select("key", "payload").write.parquet(source)
    ingest(spark, source, target, _target(spark, "progress")).awaitTermination()
    return ordering.stored_rank(read_ordered(spark, target)).select("rank", "key", payload_bytes(F.col("payload")).alias("len"))


def _order_row(spark: SparkSession, r: verify.OrderReport) -> DataFrame:
    return spark.createDataFrame([(r.ok, r.count, r.violations, r.index)], "ok boolean, n bigint, violations bigint, first_bad bigint")


def verify_order_fail(spark: SparkSession, sf: str) -> DataFrame:
    """Users in event order are not sorted; the report has the first row that is out of order."""
    by_event = ordering.range_sort(_t(spark, sf, "events").select("user_id", "event_id"), _parts(spark), "event_id")
    return _order_row(spark, verify.verify_order(by_event, "user_id"))


def verify_order_ok(spark: SparkSession, sf: str) -> DataFrame:
    s = ordering.range_sort(_t(spark, sf, "events").select("user_id", "event_id"), _parts(spark), "user_id", "event_id")
    return _order_row(spark, verify.verify_order(s, "user_id"))


def multiset_check(spark: SparkSession, sf: str) -> DataFrame:
    """Keys whose number of records differs before and after the sort, which is none."""
    before = _records(spark, sf).select("key", F.md5("payload").alias("p"))
    after = ordering.range_sort(before, _parts(spark), "key")
    same = verify.same_multiset(before, after)
    c = before.groupBy("key").agg(F.count("*").alias("n"))
    return c.select("key", "n", F.lit(same).alias("same"))


def gen_payload(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    length = F.pmod(i * 7, F.lit(25)) + 8
    return spark.range(_GEN_N).select(i.alias("i"), length.alias("len"), payload_for(i, length, 32).alias("payload"))


def gen_splits(spark: SparkSession, sf: str) -> DataFrame:
    return generate(spark, _GEN_N, 16, splits=_GEN_SPLITS).groupBy("split").agg(F.count("*").alias("n"))


_TIMES = [("a", 1, 8.0), ("a", 2, 4.0), ("a", 4, 2.5), ("b", 1, 6.0), ("b", 2, 4.0), ("b", 4, 3.0)]
_WORK = [("r1", 0, "sort", 2.0), ("r1", 1, "sort", 3.0), ("r1", 0, "write", 1.0), ("r1", 1, "write", 0.5), ("r2", 0, "sort", 4.0)]


def stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.scaling(spark.createDataFrame(_TIMES, "variant string, workers int, seconds double"))


def phase_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.phases(spark.createDataFrame(_WORK, "run string, worker int, phase string, seconds double"))


def top_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The ten first records in key order: the limit is the feature, and Spark keeps only ten rows a partition."""
    return _records(spark, sf).select("doc_id", "key").orderBy("key", "doc_id").limit(10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        decode_keys, record_sizes, record_roundtrip, sort_rank_u64, sort_rank_lineitem, range_partition_sort, run_local_rank,
        assign_runs, assign_splits, kway_merge, tree_merge, merge_two_stable, verify_order_fail, verify_order_ok,
        multiset_check, gen_payload, gen_splits, stage_metrics, phase_metrics, top_keys,
        recordfile_scan, recordfile_keys, recordfile_append, recordfile_splits, recordfile_sampled_splits, recordfile_sort_publish,
        recordfile_verify, sorted_runs, key_clamp, generated_file, stream_ingest,
    )
}

_RANKED = f"select doc_id, {_K} as key, row_number() over (order by {_K}, doc_id)::BIGINT as rank from documents"
_POS = "select event_id, strlen(coalesce(props,''))+12 as size, sum(strlen(coalesce(props,''))+12) over (order by event_id) as end_byte from events"
_ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::{'DOUBLE' if isinstance(x, float) else 'INTEGER'}" for x in r) + ")" for r in rows)


_LEN = "strlen(coalesce(text,''))"
_IN_FILE = f"select doc_id, {_K} as key, {_LEN}::BIGINT as len, md5(coalesce(text,'')) as payload_md5, {_LEN} + 12 as size, sum({_LEN} + 12) over (order by doc_id) as upto from documents where doc_id is not null"

ORACLE: dict[str, str] = {
    "decode_keys": f"select doc_id, {_K} as key, ({_U})::varchar as key_u64 from documents",
    "record_sizes": "select doc_id, strlen(coalesce(text,''))::BIGINT as len, (strlen(coalesce(text,''))+12)::BIGINT as size from documents",
    "record_roundtrip": f"select {_K} as key, strlen(coalesce(text,''))::BIGINT as len, md5(coalesce(text,'')) as payload_md5 from documents",
    "sort_rank_u64": _RANKED,
    "sort_rank_lineitem": f"select {', '.join(LINE)}, row_number() over (order by {', '.join(LINE)})::BIGINT as rank from lineitem",
    "range_partition_sort": "select o_custkey, o_orderkey, row_number() over (order by o_custkey, o_orderkey)::BIGINT as rank from orders",
    "run_local_rank": f"select doc_id, {_K} as key, (doc_id // 128)::BIGINT as run_id, row_number() over (partition by doc_id // 128 order by {_K}, doc_id)::BIGINT as run_rank from documents",
    "assign_runs": f"with p as ({_POS}) select ((end_byte-1)//{_RUN_BYTES})::BIGINT as run_id, count(*) as n, min(event_id) as lo, max(event_id) as hi from p group by 1",
    "assign_splits": f"with p as ({_POS}), t as (select max(end_byte) as total from p), s as (select size, ({' + '.join(f'(end_byte-size >= total*{i}//{_SPLITS})::BIGINT' for i in range(1, _SPLITS))})::BIGINT as split from p, t) select split, count(*) as n, sum(size)::BIGINT as bytes from s group by 1",
    "kway_merge": _RANKED,
    "tree_merge": _RANKED,
    "merge_two_stable": "select user_id as key, event_id as pos, (event_id % 2)::INTEGER as src, row_number() over (order by user_id, event_id % 2, event_id)::BIGINT as rank from events",
    "verify_order_fail": "with l as (select user_id, lag(user_id) over (order by event_id) as prev, row_number() over (order by event_id)-1 as i from events) select count(*) filter (user_id < prev) = 0 as ok, count(*) as n, count(*) filter (user_id < prev) as violations, min(i) filter (user_id < prev) as first_bad from l",
    "verify_order_ok": "select true as ok, count(*) as n, 0::BIGINT as violations, null::BIGINT as first_bad from events",
    "multiset_check": f"select {_K} as key, count(*) as n, true as same from documents group by 1",
    "gen_payload": f"select i, (i*7 % 25 + 8) as len, substr('{_ALPHA}', (i % 26 + 1)::INTEGER, (i*7 % 25 + 8)::INTEGER) as payload from range({_GEN_N}) t(i)",
    "gen_splits": f"select least(i // {_GEN_N // _GEN_SPLITS}, {_GEN_SPLITS - 1})::BIGINT as split, count(*) as n from range({_GEN_N}) t(i) group by 1",
    "stage_metrics": f"with t(variant, workers, seconds) as (values {_values(_TIMES)}), b as (select variant as v, seconds as one from t where workers = 1) select variant, workers, seconds, one/seconds as speedup, one/seconds/workers as efficiency from t join b on v = variant",
    "phase_metrics": f"with t(run, worker, phase, seconds) as (values {_values(_WORK)}) select run, phase, max(seconds) as wall_seconds, sum(seconds) as work_seconds from t group by 1, 2",
    "top_keys": f"select doc_id, {_K} as key from documents order by 2, 1 limit 10",
    "recordfile_scan": f"select {_K} as key, {_LEN}::BIGINT as len, md5(coalesce(text,'')) as payload_md5 from documents",
    "recordfile_keys": f"select {_K} as key from documents",
    "recordfile_append": f"select {_K} as key, count(*) as n, max({_LEN})::BIGINT as len from documents group by 1",
    "recordfile_splits": f"""with p as ({_IN_FILE}), t as (select max(upto) as total, ceil(max(upto) / {_FILE_SPLIT})::BIGINT as parts from p),
c as (select total * i // parts as target from t, range(1, parts) r(i)),
s as (select size, (select count(*) from c where target <= upto - size) as k from p)
select row_number() over (order by k)::BIGINT as split, count(*) as n, sum(size)::BIGINT as bytes from s group by k""",
    "recordfile_sampled_splits": f"with p as ({_IN_FILE}) select row_number() over (order by doc_id)::BIGINT as rank, key, len, payload_md5 from p",
    "recordfile_sort_publish": f"with p as ({_IN_FILE}) select row_number() over (order by key)::BIGINT as rank, key, len, payload_md5 from p",
    "recordfile_verify": f"with l as (select key, lag(key) over (order by key) as prev from ({_IN_FILE})) select count(*) filter (key < prev) = 0 as ok, count(*) as n, count(*) filter (key < prev) as violations, null::BIGINT as first_bad from l",
    "sorted_runs": f"with p as ({_IN_FILE}) select row_number() over (order by (upto - 1) // {_RUN_BYTES}, key)::BIGINT as place, key from p",
    "key_clamp": "select o_orderkey, least(greatest(o_custkey, 100), 1000)::BIGINT as clamped from orders",
    "generated_file": f"select file::BIGINT as file, ({_FILE_N // _FILE_SPLITS} + case when file = {_FILE_SPLITS} then {_FILE_N % _FILE_SPLITS} else 0 end)::BIGINT as n from range(1, {_FILE_SPLITS + 1}) t(file)",
    "stream_ingest": f"select row_number() over (order by {_K})::BIGINT as rank, {_K} as key, {_LEN}::BIGINT as len from documents",
}
