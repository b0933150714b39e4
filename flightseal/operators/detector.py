"""Label-free detector: robust z-scores within a pool of flights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    ALTITUDE_FLOOR_MPS,
    ALTITUDE_HEADROOM,
    ALTITUDE_QUANTILE,
    CONSISTENCY_FEATURES,
    MIN_PHASE_ROWS,
    Z_THRESHOLD,
)
from ..session import materialize
from . import sketches
from .quantiles import GROUP_ROWS, TOTAL_ROWS, percentiles, robust_stats

ALTITUDE_RATE = "alt_rate_mps"
_POOL, _CLIMB = "_pool", "_climb"


def phase_counts(df: DataFrame, pool: Sequence[str] = (), phase: str = "phase") -> DataFrame:
    """Rows per phase; rows without a phase are not listed."""
    return df.where(F.col(phase).isNotNull()).groupBy(*pool, phase).agg(F.count(F.lit(1)).alias("rows"))


def pool_sizes(df: DataFrame, pool: Sequence[str], phase: str = "phase") -> DataFrame:
    """Rows per (pool, phase) with the pool's rows and its smallest phase; a few rows per pool."""
    sizes = df.groupBy(*pool, phase).agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(*pool)
    smallest = F.min(F.when(F.col(phase).isNotNull(), F.col("rows"))).over(whole)
    return materialize(
        sizes.withColumns({"pool_rows": F.sum("rows").over(whole), "smallest": smallest}), "phases"
    )


def phase_stats(
    df: DataFrame,
    pool: Sequence[str],
    sizes: DataFrame,
    columns: Sequence[str] = CONSISTENCY_FEATURES,
    phase: str = "phase",
    group_rows: int = GROUP_ROWS,
    total_rows: int = TOTAL_ROWS,
) -> DataFrame:
    """Median and scale of every column per (pool, phase).

    Phases with fewer than MIN_PHASE_ROWS rows use the statistics of their whole
    pool. Rows of pools that have such a phase are counted a second time under
    the pool itself, so both levels come out of the same passes.
    """
    pool, group = list(pool), [*pool, "_whole", "_phase"]
    known, small = F.col(phase).isNotNull(), F.col("smallest") < MIN_PHASE_ROWS
    own = {"_whole": F.lit(False), "_phase": F.col(phase)}
    whole = {"_whole": F.lit(True), "_phase": F.lit("")}
    slim = df.select(*pool, phase, *columns)
    levels = slim.where(known).withColumns(own)
    level_sizes = sizes.where(known).withColumns(own).select(*group, "rows")
    if not sizes.where(small).isEmpty():
        pools = materialize(sizes.where(small).select(*pool, F.col("pool_rows").alias("rows")).distinct(), "pools")
        again = slim.join(pools.select(*pool), pool, "left_semi").withColumns(whole)
        levels = levels.unionByName(again)
        level_sizes = level_sizes.unionByName(pools.withColumns(whole))
    stats = robust_stats(levels, group, columns, level_sizes, group_rows, total_rows)

    names = [f"{c}_{part}" for c in columns for part in ("median", "scale")]
    lookup = {"_whole": F.col("rows") < MIN_PHASE_ROWS}
    lookup["_phase"] = F.when(lookup["_whole"], F.lit("")).otherwise(F.col(phase))
    wanted = sizes.where(known).select(*pool, phase, "rows").withColumns(lookup)
    return materialize(wanted.join(stats, group).select(*pool, phase, *names), "phase_stats")


def altitude_bounds(
    df: DataFrame,
    pool: Sequence[str],
    sizes: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
    total_rows: int = TOTAL_ROWS,
) -> DataFrame:
    """The largest plausible climb or descent rate of every pool."""
    if sizes is not None:
        sizes = sizes.groupBy(*pool).agg(F.max("pool_rows").alias("rows"))
    wanted = {"_top": (F.abs(F.col(ALTITUDE_RATE)), ALTITUDE_QUANTILE)}
    top = percentiles(df, pool, wanted, (), sizes, group_rows, total_rows)
    return materialize(top.select(*pool, _altitude_bound(F.col("_top")).alias("alt_bound")), "altitude")


def _altitude_bound(top: Column) -> Column:
    return F.greatest(F.lit(ALTITUDE_FLOOR_MPS), top * ALTITUDE_HEADROOM)


def narrowed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature values at the single precision they are published in."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


def robust_z(
    df: DataFrame,
    pool: Sequence[str],
    sizes: DataFrame,
    columns: Sequence[str] = CONSISTENCY_FEATURES,
    phase: str = "phase",
    group_rows: int = GROUP_ROWS,
    total_rows: int = TOTAL_ROWS,
) -> DataFrame:
    """Adds `z_<c>`: distance from the row's own phase in robust units.

    0 where the column does not vary or the row has no phase.
    """
    pool = list(pool)
    return _with_z(df, pool, phase_stats(df, pool, sizes, columns, phase, group_rows, total_rows), columns, phase)


def _with_z(df: DataFrame, pool: list[str], stats: DataFrame, columns: Sequence[str], phase: str) -> DataFrame:
    rows = df.join(stats, [*pool, phase], "left")
    z = {
        f"z_{c}": F.when(F.col(f"{c}_scale").isNull(), 0.0).otherwise(
            (F.col(c) - F.col(f"{c}_median")) / F.col(f"{c}_scale")
        )
        for c in columns
    }
    return rows.withColumns(z).select(*df.columns, *z)


def altitude_plausibility(
    df: DataFrame,
    pool: Sequence[str],
    sizes: DataFrame | None = None,
    threshold: float = Z_THRESHOLD,
    group_rows: int = GROUP_ROWS,
    total_rows: int = TOTAL_ROWS,
) -> DataFrame:
    """Adds `z_alt_rate_mps`: `threshold` exactly at the plausibility bound, linear beyond."""
    bounds = altitude_bounds(df, pool, sizes, group_rows, total_rows)
    return df.join(bounds, list(pool), "left").withColumn(f"z_{ALTITUDE_RATE}", _over_bound(threshold)).drop("alt_bound")


def _over_bound(threshold: float) -> Column:
    return F.lit(threshold) * F.abs(F.col(ALTITUDE_RATE)) / F.col("alt_bound")


def sketch_logs(features: DataFrame, pool: Sequence[str] = (), columns: Sequence[str] = CONSISTENCY_FEATURES, phase: str = "phase", k: int = sketches.K) -> DataFrame:
    """Sketches of what the detector needs to know of these rows; merge tables of several logs with `merge_sketches`."""
    rows = narrowed(features, [*columns, ALTITUDE_RATE]).withColumn(_CLIMB, F.abs(F.col(ALTITUDE_RATE)))
    return sketches.sketch_table(_pooled(rows, pool), [*(pool or [_POOL]), phase], [*columns, _CLIMB], k)


def merge_sketches(tables: Sequence[DataFrame], pool: Sequence[str] = (), columns: Sequence[str] = CONSISTENCY_FEATURES, phase: str = "phase") -> DataFrame:
    return sketches.merged(tables, [*(pool or [_POOL]), phase], [*columns, _CLIMB])


def _pooled(rows: DataFrame, pool: Sequence[str]) -> DataFrame:
    return rows if pool else rows.withColumn(_POOL, F.lit(0))


def score_baseline(
    features: DataFrame,
    pool: Sequence[str] = (),
    threshold: float = Z_THRESHOLD,
    columns: Sequence[str] = CONSISTENCY_FEATURES,
    phase: str = "phase",
    group_rows: int = GROUP_ROWS,
    total_rows: int = TOTAL_ROWS,
    exact: bool = True,
    known: DataFrame | None = None,
) -> DataFrame:
    """Adds `anomaly_score`, `worst_feature` and `flagged`.

    `pool` names the columns whose rows are judged together: ("source",) scores
    each flight against itself, () pools everything. The rows are written out
    first because their statistics need several passes over them. With `exact`
    False medians, scales and altitude bounds come from sketches, in one pass;
    with `known`, a table of `sketch_logs`, from that table, and the rows are
    judged by what it has of their pool and phase (nothing: their score is 0).
    """
    columns, keys = list(columns), list(pool) or [_POOL]
    rows = _pooled(narrowed(features, [*columns, ALTITUDE_RATE]), pool)
    if exact and known is None:
        rows = materialize(rows, "judged")
        sizes = pool_sizes(rows, keys, phase)
        stats = phase_stats(rows, keys, sizes, columns, phase, group_rows, total_rows)
        bounds = altitude_bounds(rows, keys, sizes, group_rows, total_rows)
    else:
        if known is None:
            rows = materialize(rows, "judged")
            known = sketch_logs(rows, pool, columns, phase)
        known = materialize(known, "sketches")
        stats = materialize(sketches.phase_stats(known, keys, columns, phase), "phase_stats")
        top = sketches.pool_quantile(known, keys, _CLIMB, ALTITUDE_QUANTILE, "_top")
        bounds = materialize(top.select(*keys, _altitude_bound(F.col("_top")).alias("alt_bound")), "altitude")
    scored = _with_z(rows, keys, stats, columns, phase)
    scored = scored.join(bounds, keys, "left").withColumn(f"z_{ALTITUDE_RATE}", _over_bound(threshold))
    ordered = [*columns, ALTITUDE_RATE]
    size = {c: F.coalesce(F.abs(F.col(f"z_{c}")), F.lit(0.0)) for c in ordered}
    scored = scored.withColumn("anomaly_score", F.greatest(*size.values()))
    worst = F.lit(ordered[-1])
    for c in reversed(ordered[:-1]):
        worst = F.when(size[c] == F.col("anomaly_score"), F.lit(c)).otherwise(worst)
    scored = scored.withColumns({"worst_feature": worst, "flagged": F.col("anomaly_score") > threshold})
    return scored.drop(_POOL, "alt_bound", *[f"z_{c}" for c in ordered])
