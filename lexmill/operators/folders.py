"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir; where that is unset, in local mode, under one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/scratch/{uuid.uuid4().hex}"


def rewrite(spark: SparkSession, file: str, skip: int = 0, before: bytes = b"", after: bytes = b"") -> None:
    """Replaces a file by `before`, what it holds from byte `skip` on, and `after`; it is copied in pieces, so it may be of any size."""
    path, copy = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    system = path(file).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = path(f"{file}.rewriting")
    source = system.open(path(file))
    sink = system.create(aside, True)
    source.seek(skip)
    if before:
        sink.write(bytearray(before))
    copy(source, sink, 1 << 16, False)
    if after:
        sink.write(bytearray(after))
    source.close()
    sink.close()
    system.delete(path(file), False)
    system.rename(aside, path(file))
