"""The raw CSV load as a restartable file stream.

The reference loads its three CSV exports once. When exports keep arriving
(one file per day, say), the same load runs as a Structured Streaming
query: new files under ``source`` are read with the declared all-string
schema and appended as Parquet under ``target``. The checkpoint records
which files were loaded, so a restart after a failure loads each file
exactly once. ``available_now`` processes what is there and stops, which
makes the stream a drop-in for the one-off load. With ``malformed``, the
text of each row of the wrong shape is kept as the batch load keeps it, and
``load_counts`` counts the rows and those from what has been committed, so
restarts and batches that ran twice change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from churnkit.sources.csv import CSV_FORMAT


def stream_raw_csv(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    malformed: str | None = None,
) -> StreamingQuery:
    reader = spark.readStream
    if malformed:
        schema = T.StructType([*schema.fields, T.StructField(malformed, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", malformed)
    reader = reader.schema(schema).options(**CSV_FORMAT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = (
        reader.csv(source)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def load_counts(spark: SparkSession, target: str, malformed: str) -> DataFrame:
    """One row: ``total_rows`` and ``malformed_rows`` of a table that ``stream_raw_csv`` wrote with ``malformed``."""
    return spark.read.parquet(target).agg(F.count(F.lit(1)).alias("total_rows"), F.count(malformed).alias("malformed_rows"))
