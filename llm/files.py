"""Files in the folder that driver and executors share, opened by its URI."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from keytide.workspace import shared_folder


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder's URI; made here, so that tasks only add files to it."""
    uri = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    return uri


def part_name(suffix: str) -> str:
    """A name that no other attempt of this task uses: only the attempt whose rows are kept is ever read."""
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"part-{c.partitionId():06d}-{c.taskAttemptId()}{suffix}"
