"""Files in the shared folder, from Python on any executor: local paths directly, other schemes through Arrow's file systems. What the driver writes goes through Hadoop's FileSystem, which knows every scheme Spark knows."""

from __future__ import annotations

import os
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _arrow(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def create(uri: str) -> BinaryIO:
    """Open a new file for writing, its folder made if need be."""
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    system, path = _arrow(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def read(uri: str) -> BinaryIO:
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    system, path = _arrow(uri)
    return system.open_input_stream(path)


def move(old: str, new: str) -> None:
    """Rename a file from any executor; a move that an earlier try has made already counts as done. Raises where neither name exists."""
    if (path := _local(old)) is not None:
        try:
            os.replace(path, _local(new))
        except FileNotFoundError:
            if not os.path.exists(_local(new)):
                raise
        return
    from pyarrow.fs import FileType

    system, path = _arrow(old)
    _, to = _arrow(new)
    if system.get_file_info(path).type == FileType.NotFound:
        if system.get_file_info(to).type == FileType.NotFound:
            raise FileNotFoundError(old)
        return
    if system.get_file_info(to).type != FileType.NotFound:
        system.delete_file(to)
    system.move(path, to)


def rename(spark: SparkSession, moves: list[tuple[str, str]]) -> None:
    """Rename each file; a move that an earlier try has made already counts as done. Raises where neither name exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for old, new in moves:
        a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
        system = a.getFileSystem(conf)
        if system.exists(a):
            system.delete(b, False)
            if not system.rename(a, b):
                raise OSError(f"{old} could not be renamed to {new}")
        elif not system.exists(b):
            raise FileNotFoundError(old)


def put(spark: SparkSession, uri: str, text: str) -> None:
    """Write a small text under a temporary name, then rename it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tmp = jvm.org.apache.hadoop.fs.Path(uri + ".tmp")
    out = tmp.getFileSystem(conf).create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename(spark, [(uri + ".tmp", uri)])
