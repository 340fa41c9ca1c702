"""The few file operations that DataFrame readers and writers do not offer, by the session's Hadoop file systems."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """A file with this text, whole from its first moment; False where one of that name exists.

    The text is written beside and renamed, which on HDFS is one step that fails where the name is
    taken. Where a store's rename is not (some object stores), one writer at a time is asked for.
    """
    fs, target = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    replace_none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(beside, target, replace_none)
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def children(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Names and modification times (seconds) in a folder; none where it does not exist."""
    fs, p = _at(spark, path)
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def replace(spark: SparkSession, new: str, old_uri: str) -> None:
    """The new file takes the place of the one at a URI (as rows name it) in one rename."""
    fs, source = _at(spark, new)
    target = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(old_uri))
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(source, fs.makeQualified(target), overwrite)
