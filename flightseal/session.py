"""Session settings and tables written between stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

WINDOW_ROWS_CONF = "spark.flightseal.windowRows"
DEFAULT_WINDOW_ROWS = 1 << 18


def window_rows(spark: SparkSession) -> int:
    """Most rows one flight may put into one window task before it is split."""
    return int(spark.conf.get(WINDOW_ROWS_CONF, str(DEFAULT_WINDOW_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flightseal-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/flightseal/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write `df` to the shared folder, in folders per value of `by`, and read it back.

    Used where several later stages read the same result. The written table
    survives lost executors, keeps column pruning, and its file size lets the
    planner itself decide whether a join against it may be broadcast.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def concurrently(spark: SparkSession, tasks: Sequence[Callable[[], T]], most: int) -> list[T]:
    """Results of the tasks, in order; at most `most` of them submit jobs at a time, each to a scheduler pool of its own.

    Worth it where single jobs do not fill the cluster. The first error is raised once all have ended.
    """

    def in_pool(at: int, task: Callable[[], T]) -> Callable[[], T]:
        def run() -> T:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"flightseal-{at % most}")
            return task()

        return inheritable_thread_target(run)

    with ThreadPoolExecutor(max(1, most)) as pool:
        return [future.result() for future in [pool.submit(in_pool(at, task)) for at, task in enumerate(tasks)]]
