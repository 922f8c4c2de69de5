"""Files of tables, by the file system that their path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if there is one."""
    fs, where = _at(spark, path)
    fs.delete(where, True)


def overwrite(spark: SparkSession, path: str, content: bytes) -> None:
    fs, where = _at(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(content))
    out.close()


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows the prefix in the names of the folders just below path."""
    fs, where = _at(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()]
    return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))
