"""Exact quantiles and robust centre/scale for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAD_TO_STD, MIN_SCALE
from ..session import materialize
from .running import running_sums

# The built-in exact percentile buffers the distinct values of every group a task
# works on. It is used where groups are small, or where all rows together are few.
GROUP_ROWS = 1 << 14
TOTAL_ROWS = 1 << 18
_ACCURACY = 10_000
_MARGIN = 4 / _ACCURACY
# Below this many values the margin is less than two ranks wide: keep them all.
_KEEP_ALL = 2 * _ACCURACY

Wanted = dict[str, tuple[Column, float]]


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Wanted,
    also: Sequence[Column] = (),
    sizes: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
    total_rows: int = TOTAL_ROWS,
) -> DataFrame:
    """One row per group: every wanted quantile (linear interpolation, NULL skipped).

    `also` are plain aggregates to compute on the way; `sizes` are the rows per
    group where they are known already. Groups above `group_rows` go through
    bounded counting, the others through the built-in percentile. Fewer than
    total / group_rows groups can be large, so the list that separates them is
    short.
    """
    keys = list(keys)
    sizes = group_sizes(df, keys) if sizes is None else sizes
    total, largest, groups = sizes.agg(F.sum("rows"), F.max("rows"), F.count(F.lit(1))).first()
    if (total or 0) <= total_rows or largest <= group_rows:
        return _builtin(df, keys, wanted, also)
    if not keys:
        return _counted(df, keys, wanted, also)
    large = materialize(sizes.where(F.col("rows") > group_rows).select(*keys), "large")
    out = _counted(df.join(large, keys, "left_semi"), keys, wanted, also)
    if large.count() < groups:
        out = out.unionByName(_builtin(df.join(large, keys, "left_anti"), keys, wanted, also))
    return out


def _builtin(df: DataFrame, keys: list[str], wanted: Wanted, also: Sequence[Column]) -> DataFrame:
    exact = [F.percentile(value, share).alias(name) for name, (value, share) in wanted.items()]
    return df.groupBy(*keys).agg(*exact, *also)


def _counted(df: DataFrame, keys: list[str], wanted: Wanted, also: Sequence[Column]) -> DataFrame:
    """Exact quantiles without holding a group in a task.

    Approximate quantiles bound each wanted value from both sides. Only values
    strictly inside the bounds are then counted one by one; everything below,
    and ties on a bound, are single counts. Where the bounds missed the wanted
    rank, the groups and quantiles concerned are done again with twice the
    margin; from half of the ranks on the bounds are the extremes.
    """
    group = keys or ["_all"]
    keyed = df if keys else df.withColumn("_all", F.lit(0))
    slim = keyed.withColumns({f"_v_{name}": value.cast("double") for name, (value, _) in wanted.items()})
    shares, margin, found = {name: share for name, (_, share) in wanted.items()}, _MARGIN, []
    base = missed = None
    rows = slim
    while shares:
        bounds = _bounds(rows, group, shares, also if base is None else (), margin)
        picked = _picked(rows, group, shares, bounds)
        if base is None:
            base = bounds
        else:
            picked = picked.join(missed, [*group, "_name"], "left_semi")
        picked = materialize(picked, "picked")
        found.append(picked.where(~F.col("_missed")).select(*group, "_name", "_found"))
        missed = picked.where("_missed").select(*group, "_name")
        again = {r["_name"] for r in missed.select("_name").distinct().collect()}
        shares, margin = {name: share for name, share in shares.items() if name in again}, margin * 2
        rows = slim.join(missed.select(*group).distinct(), group, "left_semi")
    wide = reduce(DataFrame.unionByName, found).groupBy(*group).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_found"))).alias(name) for name in wanted]
    )
    extra = [c for c in base.columns if c not in group and not c.startswith(("_n_", "_lo_", "_hi_"))]
    return base.select(*group, *extra).join(wide, group, "left").select(*keys, *wanted, *extra)


def _bounds(rows: DataFrame, group: list[str], shares: dict[str, float], also: Sequence[Column], margin: float) -> DataFrame:
    """Count, lower and upper bound of every wanted value per group; written."""
    limits = []
    for name, share in shares.items():
        value = F.col(f"_v_{name}")
        around = F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin)))
        near = F.percentile_approx(value, around, _ACCURACY)
        few = F.count(value) < _KEEP_ALL if margin < 0.5 else F.lit(True)
        limits += [
            F.count(value).alias(f"_n_{name}"),
            F.when(few, F.min(value)).otherwise(near[0]).alias(f"_lo_{name}"),
            F.when(few, F.max(value)).otherwise(near[1]).alias(f"_hi_{name}"),
        ]
    return materialize(rows.groupBy(*group).agg(*limits, *also), "bounds")


def _picked(rows: DataFrame, group: list[str], shares: dict[str, float], bounds: DataFrame) -> DataFrame:
    """(group, _name, _found, _missed): the wanted values by counting, or that the bounds missed them."""

    def column(prefix: str, name: str) -> Column:
        return F.col(f"_{prefix}_{name}")

    def entry(name: str, value: Column, count: Column) -> Column:
        at = (column("n", name) - 1) * F.lit(shares[name])
        parts = {"_name": F.lit(name), "_at": at, "_value": value.cast("double"), "_rows": count.cast("long")}
        return F.struct(*[part.alias(label) for label, part in parts.items()])

    # Values strictly inside the bounds are few; ties on a bound are only counted.
    limits = bounds.select(*group, *[f"_{part}_{name}" for name in shares for part in ("n", "lo", "hi")])
    bounded = rows.select(*group, *[f"_v_{name}" for name in shares]).join(limits, group)
    inside = {n: (column("v", n) > column("lo", n)) & (column("v", n) < column("hi", n)) for n in shares}
    near = bounded.where(reduce(or_, inside.values())).select(
        *group, F.inline(F.array(*[entry(n, F.when(inside[n], column("v", n)), F.lit(1)) for n in shares]))
    )
    near = near.where(F.col("_value").isNotNull()).groupBy(*group, "_name", "_at", "_value").agg(F.sum("_rows").alias("_rows"))
    edge_counts = []
    for n in shares:
        value, low, high = column("v", n), column("lo", n), column("hi", n)
        edge_counts += [
            F.count_if(value < low).alias(f"_below_{n}"),
            F.count_if(value == low).alias(f"_low_{n}"),
            F.count_if((value == high) & (high > low)).alias(f"_high_{n}"),
        ]
    edges = bounded.groupBy(*group).agg(*edge_counts).join(limits, group)
    entries = []
    for n in shares:
        entries += [
            entry(n, F.lit(None), column("below", n)),
            entry(n, column("lo", n), column("low", n)),
            entry(n, column("hi", n), column("high", n)),
        ]
    edges = edges.select(*group, F.inline(F.array(*entries))).where(F.col("_rows") > 0)
    counted = near.unionByName(edges)
    ranked = running_sums(counted, [*group, "_name", "_at"], "_value", ["_rows"], descending=False)

    def value_at(rank: Column) -> Column:
        covers = (F.col("cum__rows") - F.col("_rows") <= rank) & (rank < F.col("cum__rows"))
        return F.max(F.when(covers, F.col("_value")))

    picked = ranked.groupBy(*group, "_name", "_at").agg(
        value_at(F.floor("_at")).alias("_low"), value_at(F.ceil("_at")).alias("_high")
    )
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    return picked.select(*group, "_name", value.alias("_found"), value.isNull().alias("_missed"))


def robust_stats(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    sizes: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
    total_rows: int = TOTAL_ROWS,
) -> DataFrame:
    """`<c>_median` and `<c>_scale` per group.

    Scale is 1.4826 * MAD, or the sample standard deviation where that
    collapses, or NULL where the column does not vary.
    """
    keys = list(keys)
    medians: Wanted = {f"{c}_median": (F.col(c), 0.5) for c in columns}
    stds = [F.stddev_samp(c).alias(f"{c}_std") for c in columns]
    centres = materialize(percentiles(df, keys, medians, stds, sizes, group_rows, total_rows), "centres")
    away = df.select(*keys, *columns).join(centres, keys)
    mads: Wanted = {f"{c}_mad": (F.abs(F.col(c) - F.col(f"{c}_median")), 0.5) for c in columns}
    spreads = percentiles(away, keys, mads, (), sizes, group_rows, total_rows)
    both = centres.join(spreads, keys)
    out = []
    for c in columns:
        scale = F.col(f"{c}_mad") * MAD_TO_STD
        std = F.when(F.col(f"{c}_std") > MIN_SCALE, F.col(f"{c}_std"))
        out += [F.col(f"{c}_median"), F.when(scale < MIN_SCALE, std).otherwise(scale).alias(f"{c}_scale")]
    return both.select(*keys, *out)
