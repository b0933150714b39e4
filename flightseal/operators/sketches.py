"""Approximate medians and scales from mergeable sketches of values.

A sketch table has one row per (pool, phase) with a KLL sketch and two moments
of every column. Tables of further logs are merged into it without their rows
being read again, in any order. A quantile of a sketch is a value whose rank is
off by at most `rank_error(k)` of the rows, with 99 percent confidence.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAD_TO_STD, MIN_PHASE_ROWS, MIN_SCALE

#: Accuracy of a sketch: values that its last level keeps.
K = 2000
#: Ranks at which a sketch is read for the distances from its median.
_GRID = 2000


def rank_error(k: int = K) -> float:
    """Largest error of a rank, as a share of the rows, for two-sided bounds."""
    return 2.446 / k**0.9433


def scale_error(k: int = K) -> float:
    """The same for the median of the distances from the median: two ranks and the step of the grid."""
    return 3 * rank_error(k) + 1 / _GRID


def sketch_table(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int = K) -> DataFrame:
    """Rows, sketches and moments per group; partial sketches are built where the rows are."""
    parts = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        value = F.col(c).cast("double")
        parts += [
            F.kll_sketch_agg_double(value, k).alias(f"{c}_sketch"),
            F.count(value).alias(f"{c}_n"),
            F.coalesce(F.avg(value), F.lit(0.0)).alias(f"{c}_mean"),
            F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias(f"{c}_m2"),
        ]
    return df.groupBy(*keys).agg(*parts)


def merged(tables: Sequence[DataFrame], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One table of the rows of all: sketches merge, moments add up around the common mean."""
    parts = [F.sum("rows").alias("rows")]
    for c in columns:
        n, mean, m2 = F.col(f"{c}_n"), F.col(f"{c}_mean"), F.col(f"{c}_m2")
        total = F.sum(n)
        centre = F.try_divide(F.sum(n * mean), total)
        parts += [
            F.kll_merge_agg_double(f"{c}_sketch").alias(f"{c}_sketch"),
            total.alias(f"{c}_n"),
            F.coalesce(centre, F.lit(0.0)).alias(f"{c}_mean"),
            # around each part's own mean, and of these means around the common one
            F.coalesce(F.sum(m2) + F.sum(n * mean * mean) - total * centre * centre, F.lit(0.0)).alias(f"{c}_m2"),
        ]
    return reduce(DataFrame.unionByName, tables).groupBy(*keys).agg(*parts)


def _quantile(sketch: Column, rank: Column, n: Column) -> Column:
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, rank))


def _distance_from(centre: Column):
    return lambda value: F.abs(value - centre)


def robust(table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`<c>_median` and `<c>_scale` per group, as the exact statistics define them."""
    ranks = F.array(*[F.lit((i + 0.5) / _GRID) for i in range(_GRID)])
    out = []
    for c in columns:
        sketch, n = F.col(f"{c}_sketch"), F.col(f"{c}_n")
        median = _quantile(sketch, F.lit(0.5), n)
        away = F.sort_array(F.transform(_quantile(sketch, ranks, n), _distance_from(median)))
        scale = F.element_at(away, _GRID // 2) * MAD_TO_STD
        std = F.when(n > 1, F.sqrt(F.greatest(F.col(f"{c}_m2"), F.lit(0.0)) / (n - 1)))
        std = F.when(std > MIN_SCALE, std)
        out += [median.alias(f"{c}_median"), F.when(scale < MIN_SCALE, std).otherwise(scale).alias(f"{c}_scale")]
    return table.select(*keys, "rows", *out)


def phase_stats(table: DataFrame, pool: Sequence[str], columns: Sequence[str], phase: str = "phase") -> DataFrame:
    """Statistics of every known phase; phases of few rows get those of their whole pool."""
    pool = list(pool)
    own = robust(table.where(F.col(phase).isNotNull()), [*pool, phase], columns)
    whole = robust(merged([table], pool, columns), pool, columns).drop("rows")
    names = [f"{c}_{part}" for c in columns for part in ("median", "scale")]
    whole = whole.select(*pool, *[F.col(n).alias(f"_{n}") for n in names])
    both = own.join(whole, pool)
    few = F.col("rows") < MIN_PHASE_ROWS
    return both.select(*pool, phase, *[F.when(few, F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in names])


def pool_quantile(table: DataFrame, pool: Sequence[str], column: str, share: float, name: str) -> DataFrame:
    """A quantile of `column` over all rows of every pool."""
    whole = merged([table.select(*pool, "rows", *[f"{column}_{p}" for p in ("sketch", "n", "mean", "m2")])], pool, [column])
    return whole.select(*pool, _quantile(F.col(f"{column}_sketch"), F.lit(share), F.col(f"{column}_n")).alias(name))
