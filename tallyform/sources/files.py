"""Small files of the store: written whole or not at all, read by the driver."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _local(spark: SparkSession, path: str) -> str | None:
    """The path on the driver's own disk, if it is one."""
    place, fs = _path(spark, path)
    return unquote(urlparse(fs.makeQualified(place).toString()).path) if fs.getScheme() == "file" else None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    place, fs = _path(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    place, fs = _path(spark, path)
    source = fs.open(place)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist; False if it does. Of several writers one succeeds, and a reader sees all of it or none.

    The text is written beside it first. A local file is then linked under its name, elsewhere the file is renamed without
    overwriting, which has to be atomic there (as on HDFS)."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    write_text(spark, draft, text)
    local = _local(spark, path)
    try:
        if local is not None:
            os.link(_local(spark, draft), local)
            return True
        fc = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path)[1].getUri(), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        fc.rename(_path(spark, draft)[0], _path(spark, path)[0], options)
        return True
    except FileExistsError:
        return False
    except Exception as exc:
        if "FileAlreadyExistsException" not in str(exc):
            raise
        return False
    finally:
        delete(spark, draft)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    place, fs = _path(spark, path)
    if not fs.exists(place):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(place))


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _path(spark, path)
    fs.delete(place, True)
