"""Sinks: publish finished tables, replacing what was there (full refresh).

A set of tables is published in two steps. Every table is first written in full under a
version folder of its own; then one small manifest is exchanged, which names
the version to read. A run that fails in between leaves the manifest, and so the old
set, as it was; no reader meets old and new tables side by side. Version
folders beyond the newest ones are removed after the exchange, the current and the
one before it being kept for readers that have just opened them.

Files are reached through Hadoop's file interface, so a root may be any
store that Spark can write to.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

MANIFEST, VERSIONS = "current.json", "versions"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write ``df`` at ``path``, replacing any previous version of the table."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all it holds; False if it is not there."""
    return file_system(spark, path).delete(_path(spark, path), True)


def _exchange(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see either the old or the new one: written aside, then renamed over."""
    aside = f"{path}.{uuid.uuid4().hex[:12]}"
    out = file_system(spark, path).create(_path(spark, aside), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    modes = spark.sparkContext._gateway.new_array(rename, 1)
    modes[0] = rename.valueOf("OVERWRITE")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, aside), _path(spark, path), modes)


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The current version of a published set, or None where none was finished."""
    path = f"{root.rstrip('/')}/{MANIFEST}"
    if not file_system(spark, path).exists(_path(spark, path)):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current version."""
    current = manifest(spark, root)
    if current is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.format(current["format"]).load(f"{root.rstrip('/')}/{current['tables'][name]}")


def publish_tables(spark: SparkSession, tables: Mapping[str, Callable[[], DataFrame]], root: str, fmt: str = "parquet", keep: int = 2) -> dict[str, str]:
    """Write all tables as one new version, then make it the current one; the path of each table."""
    root = root.rstrip("/")
    version = f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    inside = {name: f"{VERSIONS}/{version}/{name}" for name in tables}
    for name, build in tables.items():
        write_table(build(), f"{root}/{inside[name]}", fmt)
    _exchange(spark, f"{root}/{MANIFEST}", json.dumps({"version": version, "format": fmt, "tables": inside}))
    fs, folder = file_system(spark, root), f"{root}/{VERSIONS}"
    held = sorted(s.getPath().getName() for s in fs.listStatus(_path(spark, folder)) if s.isDirectory())
    for old in [v for v in held if v < version][:-(keep - 1) or None]:
        remove_folder(spark, f"{folder}/{old}")
    return {name: f"{root}/{path}" for name, path in inside.items()}
