"""Files in any store that Spark reaches: existence, folders, copies, and a cache of remote paths."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def make_dirs(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def copy(spark: SparkSession, source: str, target: str) -> bool:
    """A file or a folder, between stores as well."""
    (a, fa), (b, fb) = _path(spark, source), _path(spark, target)
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file of the driver's."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the store that all executors share: spark.checkpoint.dir, or the warehouse where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def cached(spark: SparkSession, source: str, cache: str, again: bool = False) -> str:
    """Path of a copy of ``source`` below ``cache``, in a folder named by the md5 of the source's path.

    The copy is made under another name and renamed, so a reader sees all of it or
    nothing, and of several copies at a time the first one stays.
    """
    folder = f"{cache.rstrip('/')}/{hashlib.md5(source.encode()).hexdigest()}"
    target = f"{folder}/{source.rstrip('/').rpartition('/')[2]}"
    if again:
        remove(spark, target)
    if not exists(spark, target):
        part = f"{folder}/.{uuid.uuid4().hex}"
        make_dirs(spark, folder)
        copy(spark, source, part)
        (a, fs), (b, _) = _path(spark, part), _path(spark, target)
        if not fs.rename(a, b):
            remove(spark, part)
    return target
