"""Session settings and shared storage for intermediate tables.

Intermediate tables (the staging layer, the analysis base, the ordered
tables of the ordering helper) are written as Parquet under the folder the
cluster names in ``spark.checkpoint.dir``, so they survive the loss of
executors and cut long lineages. That setting is read from the session;
only when it is unset on a local master (tests, a laptop) is a private
folder chosen.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from churnkit.sources.sinks import remove_folder

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "churnkit",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CHURNKIT_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@dataclass(eq=False)
class Scratch:
    """Intermediate tables: names of bucketed ones in the catalog, and folders."""

    tables: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)


_RECORDERS: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this application (a shared path on a cluster)."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for intermediate tables")
        conf = tempfile.mkdtemp(prefix="churnkit-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/churnkit/{name}-{uuid.uuid4().hex[:12]}"
    for made in _RECORDERS:
        made.folders.append(path)
    return path


def _table_name(path: str) -> str:
    return "churnkit_" + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])


def materialize_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table bucketed and sorted by ``key``; return a scan of it.

    Tables bucketed the same way on the same key join and aggregate on it
    without a shuffle. Rows are first hash-partitioned into ``buckets``
    partitions (the bucketing hash), so each bucket is one file.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = _table_name(path)
    rows = df.repartition(buckets, key)
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    for made in _RECORDERS:
        made.tables.append(table)
    return spark.table(table)


@contextmanager
def recorded(into: Scratch) -> Iterator[None]:
    """Note in ``into`` which intermediate tables are made meanwhile."""
    _RECORDERS.append(into)
    try:
        yield
    finally:
        _RECORDERS.remove(into)


def remove_scratch(spark: SparkSession, made: Scratch) -> None:
    """Remove recorded tables from the catalog, and the folders of all that was recorded."""
    while made.tables:
        spark.sql(f"DROP TABLE IF EXISTS {made.tables.pop()}")
    while made.folders:
        remove_folder(spark, made.folders.pop())


def materialize_observed(df: DataFrame, name: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``materialize``, with aggregates over the rows taken while they are written (no further pass)."""
    seen = Observation()
    return materialize(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), name), seen.get


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    Later jobs read the files instead of recomputing the lineage, and a
    scan of written files gives the same rows in the same order on every
    evaluation, which the ordering helper relies on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
