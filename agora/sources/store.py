"""Small files that make larger writes all-or-nothing: commit marks and a pointer.

They go through Hadoop's file system API, so they stand beside the tables in
whatever store these are in. A file appears whole: it is written under
another name and renamed, over an older one where asked for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _context(spark: SparkSession, path: str):
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    whole = fs.Path(path)
    return fs, whole, whole.getFileSystem(conf)


def exists(spark: SparkSession, path: str) -> bool:
    _, p, system = _context(spark, path)
    return system.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """File and folder names in ``folder``, sorted; none if it is not there."""
    _, p, system = _context(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(p)) if system.exists(p) else []


def put(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """Write a small text file whole; without ``replace`` an existing one stays as it is."""
    fs, p, system = _context(spark, path)
    if not replace and system.exists(p):
        return
    aside = fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    out = system.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    option = fs.Options.Rename.OVERWRITE if replace else fs.Options.Rename.NONE
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, p, options)


def get(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if it is not there."""
    _, p, system = _context(spark, path)
    if not system.exists(p):
        return None
    source = system.open(p)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()
