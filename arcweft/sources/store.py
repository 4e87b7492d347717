"""Single text files of a project, in a local folder or in any store that Spark reads."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def is_address(path: str) -> bool:
    """Whether a path names its store, as in `hdfs://host/folder`; others are local to the driver."""
    return ":/" in path.partition("?")[0] and not os.path.isabs(path)


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folder_of(spark: SparkSession, path: str) -> str:
    """The absolute path of a folder within its store."""
    if not is_address(path):
        return os.path.abspath(path)
    fs, at = _at(spark, path)
    return fs.makeQualified(at).toUri().getPath().rstrip("/")


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, sorted; none if there is no such folder."""
    fs, at = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isFile()) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """FileNotFoundError if there is no such file, UnicodeDecodeError if it is no text."""
    if not is_address(path):
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    fs, at = _at(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    if not is_address(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        return
    fs, at = _at(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
