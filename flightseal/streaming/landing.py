"""Logs that land in a folder, scored as they arrive.

A log is complete when its file appears, so the stream only carries file paths;
every batch of files goes through the same readers and scorers as a batch run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.log_scoring import score_without_model
from ..sources.logs import read_logs
from ..sources.results import write_scored


_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def landed_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Paths of new CSV files; their content is not read here."""
    stream = spark.readStream.format("binaryFile").schema(_FILE_SCHEMA).option("pathGlobFilter", "*.csv")
    stream = stream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
    return stream.load(folder).select("path")


def score_landing(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame] = lambda logs: score_without_model(logs, pooled=False),
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Score every new log once and write its rows by detector and log.

    A batch that is retried replaces the partitions it wrote before.
    """

    def handle(batch: DataFrame, _: int) -> None:
        paths = [row["path"] for row in batch.collect()]  # at most files_per_batch paths
        if paths:
            write_scored(score(read_logs(batch.sparkSession, paths)), target)

    return (
        landed_files(spark, folder, files_per_batch)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )
