"""Small files in any storage that Spark can reach: manifests, result files and folder listings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _place(spark, path)
    return system.exists(target)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    system, target = _place(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def state(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """(path, size, seconds of the last change) of a file."""
    system, target = _place(spark, path)
    found = system.getFileStatus(target)
    return path, found.getLen(), found.getModificationTime() // 1000


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is no such file."""
    system, target = _place(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, over an old one if there is one."""
    system, target = _place(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    system, target = _place(spark, path)
    system.delete(target, True)
