"""Small driver-side files through Hadoop's file systems, so any store Spark reads will do."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    fs, p = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file by way of a new one, so readers see the old text or the new."""
    fs, p = _path(spark, path)
    part = p.suffix(".part")
    out = fs.create(part, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"could not rename {part} to {p}")


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file that must not exist; False if it does.  As exclusive as the file system's own
    creation is: on HDFS of several writers one succeeds."""
    fs, p = _path(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    try:
        out.write(text.encode())
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
