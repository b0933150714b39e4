"""Thinning of flights to a target sampling interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CASE_KEYS, ORDER, TARGET_DT_S
from ..functions.kinematics import seconds_between
from .ordering import with_position, with_previous
from .quantiles import TOTAL_ROWS, percentiles


def sampling_interval(
    df: DataFrame,
    keys: Sequence[str] = CASE_KEYS,
    order: str = ORDER,
    target_dt_s: float = TARGET_DT_S,
    limit: int | None = None,
    total_rows: int = TOTAL_ROWS,
) -> DataFrame:
    """One row: median seconds between rows of a flight, and the step that reaches the target."""
    slim = df.select(*keys, order, "timestamp")
    timed = with_previous(slim, keys, order, {"timestamp": "_before"}, limit)
    delta = seconds_between(F.col("timestamp"), F.col("_before"))
    median = percentiles(timed, [], {"median_dt_s": (delta, 0.5)}, total_rows=total_rows)
    ratio = F.try_divide(F.lit(target_dt_s), F.col("median_dt_s"))
    return median.withColumn("step", F.greatest(F.lit(1), F.bround(ratio).cast("int")))


def thin(
    df: DataFrame, step: int, keys: Sequence[str] = CASE_KEYS, order: str = ORDER, limit: int | None = None
) -> DataFrame:
    """Every step-th row of each flight, renumbered; labels stay as they are."""
    placed = with_position(df, keys, order, "_position", limit)
    kept = placed.where(F.col("_position") % step == 0)
    position = F.floor(F.col("_position") / step).cast(df.schema[order].dataType)
    return kept.withColumn(order, position).drop("_position")
