"""Files that workers open themselves, in any file system that Arrow knows."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and host, as the session's file system writes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def listed(spark: SparkSession, path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(file, bytes) of a file or of the files of a folder, hidden ones left out, in order of name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    files = [(f.getPath().toString(), f.getLen()) for f in found if f.isFile()]
    return sorted(f for f in files if f[0].endswith(suffix) and not f[0].rsplit("/", 1)[1].startswith((".", "_")))


def system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a place, and the path there."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def opened(uri: str):
    fs, path = system(uri)
    return fs.open_input_file(path)
