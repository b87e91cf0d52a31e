"""Path checks on the cluster's file system (HDFS, object stores, local),
through the Hadoop client Spark already uses; never the driver's local disk."""

from __future__ import annotations

import re

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

# Hadoop's names of stores that pyarrow opens under another one.
_SAME_STORE = {"s3a": "s3", "s3n": "s3"}


def scheme_of(path: str) -> str:
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):", path)
    return m.group(1) if m else ""


def open_in_task(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a URI or plain path, and the path inside it: for Python code in tasks.
    ``OSError`` if there is no such file system."""
    scheme = scheme_of(path)
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path)
    try:
        return pafs.FileSystem.from_uri(_SAME_STORE.get(scheme, scheme) + path[len(scheme):])
    except ValueError as e:  # pyarrow knows no such scheme
        raise OSError(f"no file system for {path}: {e}") from e


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def write_marker(spark: SparkSession, path: str, text: str = "ok\n") -> None:
    """A small marker file (e.g. 'landing complete')."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (empty if there is none); for folders with a known bound."""
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    p, fs = _fs(spark, path)
    f = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode("utf-8")
    finally:
        f.close()


def rename_new(spark: SparkSession, src: str, dst: str) -> None:
    """Rename to a name that must not exist yet."""
    p, fs = _fs(spark, src)
    to, _ = _fs(spark, dst)
    if fs.exists(to) or not fs.rename(p, to):
        raise FileExistsError(f"{dst} exists: another writer was faster")
