"""``spark.read.format("recordfile")`` and ``df.write.format("recordfile")``.

A path may be one file or a folder of part files. Files are opened through pyarrow's file systems,
so any URI that pyarrow knows will do. Options: ``split_bytes`` (default 128 MB), ``keys_only``,
``strict``, ``split_mode`` (sampled or exact), ``max_payload``, ``tails`` (a row for each range read: its records and whether
a cut-off last one, which a read that is not strict drops, was there).

Sampled cuts cost a few reads each and are checked by the tasks: a range that starts at a record and ends with one proves its last cut, so
a wrong cut makes the task before it fail; exact cuts walk all headers on the driver and are for files whose payloads look like records.

A written folder has a manifest of its part files. A write moves its parts in under new names and then replaces the manifest by a
rename, so readers see the old files or the new ones, never none; only then are the old parts deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from keytide.sources.codec import TruncatedRecord, count_range, decode_stream, encode_batch
from keytide.sources.splits import exact_splits, sampled_splits


MANIFEST = "_parts.json"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def list_record_files(path: str) -> list[tuple[str, int]]:
    """(path, size) in name order; hidden and temporary files are passed over."""
    fs, p = _fs(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(p, info.size)]
    found = {x.base_name: x for x in fs.get_file_info(pafs.FileSelector(p)) if x.type == pafs.FileType.File}
    if MANIFEST in found:
        return [(found[name].path, found[name].size) for name in _manifest(fs, p)]
    return sorted((x.path, x.size) for x in found.values() if x.base_name[0] not in "._")


def _manifest(fs: pafs.FileSystem, folder: str) -> list[str]:
    """Names of the part files in order; of a folder without a manifest, all that are not hidden."""
    if fs.get_file_info(f"{folder}/{MANIFEST}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
            return json.loads(f.read())
    return sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(folder)) if x.type == pafs.FileType.File and x.base_name[0] not in "._")


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int
    last: bool = True


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", 128 << 20))
        self.keys_only = options.get("keys_only", "false").lower() == "true"
        self.tails = options.get("tails", "false").lower() == "true"
        self.strict = options.get("strict", "true").lower() == "true"
        self.mode = options.get("split_mode", "sampled")
        self.max_payload = int(options.get("max_payload", 1 << 20))

    def partitions(self) -> list[InputPartition]:
        fs, _ = _fs(self.path)
        out: list[InputPartition] = []
        for path, size in list_record_files(self.path):
            parts = max(1, -(-size // self.split_bytes))
            if parts == 1:
                cuts = [0, size]
            else:
                with fs.open_input_file(path) as f:
                    cuts = exact_splits(f, size, parts) if self.mode == "exact" else sampled_splits(f, size, parts, self.max_payload)
            out += [_Range(path, a, b, b == size) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.end > partition.start:
            with _fs(self.path)[0].open_input_file(partition.path) as f:
                if self.tails:
                    n, left = count_range(f, partition.start, partition.end)
                    if left and not partition.last:
                        raise TruncatedRecord(f"{partition.path} has no record end at byte {partition.end}; split_mode=exact tells whether the file is damaged")
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (partition.path, n, int(left > 0), left)], names=["path", "records", "dropped", "dropped_bytes"])
                    return
                try:
                    # only a file's last record may be cut off
                    yield from decode_stream(f, partition.start, partition.end, strict=self.strict or not partition.last, keys_only=self.keys_only)
                except TruncatedRecord as e:
                    if partition.last:
                        raise
                    raise TruncatedRecord(f"{partition.path} has no record end at byte {partition.end}: a sampled cut was wrong, or the file is damaged; split_mode=exact tells which") from e


@dataclass
class _Wrote(WriterCommitMessage):
    temp: str
    part: int
    records: int


class _Writer(DataSourceArrowWriter):
    """Part names carry the partition's number; the manifest lists them in partition order. Files count from commit on."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.token = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        from pyspark import TaskContext

        fs, base = _fs(self.path)
        ctx = TaskContext.get()
        temp, n = f"{base}/.tmp-{self.token}/{ctx.partitionId()}-{ctx.taskAttemptId()}", 0
        fs.create_dir(f"{base}/.tmp-{self.token}", recursive=True)
        with fs.open_output_stream(temp) as out:
            for batch in iterator:
                out.write(encode_batch(batch))
                n += batch.num_rows
        return _Wrote(temp, ctx.partitionId(), n)

    def commit(self, messages: list[_Wrote | None]) -> None:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        old = _manifest(fs, base)
        new = []
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            new.append(f"part-{m.part:06d}-{self.token[:12]}.bin")
            fs.move(m.temp, f"{base}/{new[-1]}")
        fs.create_dir(f"{base}/.tmp-{self.token}", recursive=True)
        with fs.open_output_stream(f"{base}/.tmp-{self.token}/{MANIFEST}") as f:
            f.write(json.dumps(new if self.overwrite else old + new).encode())
        fs.move(f"{base}/.tmp-{self.token}/{MANIFEST}", f"{base}/{MANIFEST}")
        if self.overwrite:
            for name in old:
                fs.delete_file(f"{base}/{name}")
        self._clean()

    def abort(self, messages: list[_Wrote | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, base = _fs(self.path)
        if fs.get_file_info(f"{base}/.tmp-{self.token}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/.tmp-{self.token}")


class RecordFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordfile"

    def schema(self) -> str:
        if self.options.get("tails", "false").lower() == "true":
            return "path string, records bigint, dropped bigint, dropped_bytes bigint"
        return "key bigint not null" + ("" if self.options.get("keys_only", "false").lower() == "true" else ", payload binary not null")

    def reader(self, schema: StructType) -> DataSourceReader:
        list_record_files(self.options["path"])  # a missing path fails here, before any task
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordFileSource)


def concat_parts(path: str, target: str, chunk: int = 8 << 20) -> int:
    """One file from ordered parts: the format is closed under concatenation. Returns its size."""
    fs, _ = _fs(path)
    out_fs, out_path = _fs(target)
    total = 0
    with out_fs.open_output_stream(out_path) as out:
        for p, _size in list_record_files(path):
            with fs.open_input_stream(p) as f:
                while block := f.read(chunk):
                    out.write(block)
                    total += len(block)
    return total
