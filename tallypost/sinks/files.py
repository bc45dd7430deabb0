"""Small files beside the tables, through the file system of the session: markers, ledgers, indexes."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _opened(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none when there is no such folder."""
    at, fs = _opened(spark, folder)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at))


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _opened(spark, path)
    fs.delete(at, True)


def read(spark: SparkSession, path: str) -> str | None:
    at, fs = _opened(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write(spark: SparkSession, at, fs, text: str) -> None:
    stream = fs.create(at, False)
    stream.write(bytearray(text.encode()))
    stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that readers see whole or not at all; one that is there is replaced."""
    at, fs = _opened(spark, path)
    part, _ = _opened(spark, f"{at.getParent()}/.{uuid.uuid4().hex}")
    _write(spark, part, fs, text)
    if not fs.rename(part, at):
        fs.delete(at, False)
        if not fs.rename(part, at):
            raise OSError(f"cannot write {path}")


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; of several writers only one does."""
    at, fs = _opened(spark, path)
    if fs.getUri().getScheme() == "file":  # there Hadoop looks first and creates then
        local = at.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    try:
        return fs.createNewFile(at)
    except Py4JJavaError as e:
        if fs.exists(at):
            return False
        raise e
