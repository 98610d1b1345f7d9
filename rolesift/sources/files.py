"""The few file-system calls Spark readers and writers do not cover. They go
through Hadoop, so any folder that Spark can use works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _at(spark, path)
    return fs.exists(hadoop_path)


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, hadoop_path = _at(spark, folder)
    if not fs.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in fs.listStatus(hadoop_path)]


def remove(spark: SparkSession, folder: str) -> None:
    fs, hadoop_path = _at(spark, folder)
    fs.delete(hadoop_path, True)


def size(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below."""
    fs, hadoop_path = _at(spark, folder)
    return fs.getContentSummary(hadoop_path).getLength() if fs.exists(hadoop_path) else 0


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = _at(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a new file; a file that is there already is an error."""
    fs, hadoop_path = _at(spark, path)
    stream = fs.create(hadoop_path, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
