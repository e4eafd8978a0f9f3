"""Folders that tasks write to and read from without Spark's own readers: their full names, and Arrow's file systems.

A folder is qualified once on the driver, as Hadoop would (``fs.defaultFS`` for a name without a scheme), and its full name
goes to the tasks.  Tasks open it with Arrow's file systems, whose schemes are ``file``, ``s3``, ``gs``, ``abfs``, ``abfss`` and
``hdfs`` (which needs its native client).  ``s3a`` and ``s3n`` are the same stores as ``s3``; ``dbfs`` is mounted on every
machine below ``/dbfs``.  Other schemes raise an error that says so.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import SparkSession

#: Schemes that Arrow opens, and those that are other names for them.
OPENED = frozenset(("file", "s3", "gs", "gcs", "abfs", "abfss", "hdfs"))
SAME = {"s3a": "s3", "s3n": "s3"}


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme and host that Spark resolves it with.  Nothing is opened."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if path.toUri().getScheme():
        return path.toString()
    return path.makeQualified(jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf), jvm.org.apache.hadoop.fs.Path("/")).toString()


def native(uri: str) -> str:
    """A full name as Arrow knows it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or not rest.startswith("/"):
        raise ValueError(f"{uri} has no scheme; qualify it on the driver")
    if scheme == "dbfs":
        return f"file:///dbfs/{rest.lstrip('/')}"
    scheme = SAME.get(scheme, scheme)
    if scheme not in OPENED:
        raise ValueError(f"tasks can't open {uri}; name a folder of one of {', '.join(sorted({*OPENED, *SAME, 'dbfs'}))}")
    return f"file:///{rest.lstrip('/')}" if scheme == "file" else f"{scheme}:{rest}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a qualified name; to be called where it is used."""
    name = native(uri)
    return (fs.LocalFileSystem(), name.removeprefix("file://")) if name.startswith("file:") else fs.FileSystem.from_uri(name)
