"""Imports of files as they change.

A stream of files (path, content, and the time of the change) is parsed as it comes; the latest version of each file within
the watermark replaces earlier ones downstream. Graph and rules stay batch: they run over the table that is kept up here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcweft.operators import parse


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet files with rows (path, content, changed timestamp)."""
    return spark.readStream.schema("path string, content string, changed timestamp").parquet(folder)


def stream_imports(changes: DataFrame) -> DataFrame:
    """(path, ord, target, raw_statement) of every changed file, as a stream."""
    return parse.imports(parse.nodes(changes))


def keep_latest(changes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's newest version of every file to `table`/batch=N; `latest` reads the newest over all batches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by("content", "changed").alias("content"), F.max("changed").alias("changed"))
        newest.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """(path, content): the newest version of each file that `keep_latest` wrote."""
    rows = spark.read.parquet(table)
    return rows.groupBy("path").agg(F.max_by("content", F.struct("changed", "batch")).alias("content"))
