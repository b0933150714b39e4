"""Flight-level splits and exact-size samples, decided by hashes of row keys.

Membership depends only on keys and seed, so it is the same after any
repartitioning, retry or rerun.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CASE_KEYS, ORDER, SEED
from ..session import materialize, window_rows
from .numbering import sorted_places
from .running import running_sums

#: Bits of a rank, and those that a count tells apart.
_RANK_BITS, _SLICE_BITS = 63, 16


def spread_hash(keys: Sequence[str], seed: int = SEED) -> Column:
    """A non-negative 63-bit hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), 1)


def case_labels(df: DataFrame, keys: Sequence[str] = CASE_KEYS, label: str = "label") -> DataFrame:
    """Each flight with its highest row label."""
    return df.groupBy(*keys).agg(F.max(label).alias("case_label"))


def _at_most(wanted: Column, rows: Column) -> Column:
    """`wanted`, or an error where there are fewer rows."""
    return F.when(wanted <= rows, wanted).otherwise(F.raise_error("a sample is larger than the rows to draw from").cast("long"))


def proportional_quotas(sizes: DataFrame, within: Sequence[str], stratum: str, draws: Column) -> DataFrame:
    """Adds `quota`: `draws` shared over strata by size, largest remainders first.

    `sizes` has one row per stratum with its row count `n`; `draws` may use the
    group total `_total`. Equal remainders go to the smaller stratum value. More
    draws than rows are an error.
    """
    group = Window.partitionBy(*within)
    shared = sizes.withColumn("_total", F.sum("n").over(group)).withColumn(
        "_draws", _at_most(draws.cast("long"), F.col("_total"))
    )
    # Whole-number division: a float share could round across an integer.
    product = "cast(n as decimal(18,0)) * cast(_draws as decimal(18,0))"
    shared = shared.withColumn("_whole", F.expr(f"{product} div cast(_total as decimal(18,0))")).withColumn(
        "_left", F.expr(f"{product} % cast(_total as decimal(18,0))")
    )
    spare = F.col("_draws") - F.sum("_whole").over(group)
    turn = F.row_number().over(group.orderBy(F.col("_left").desc(), stratum))
    shared = shared.withColumns({"_spare": spare, "_turn": turn})
    extra = (F.col("_turn") <= F.col("_spare")).cast("long")
    return shared.withColumn("quota", F.col("_whole") + extra).drop(
        "_total", "_draws", "_whole", "_left", "_spare", "_turn"
    )


def slice_counts(df: DataFrame, strata: Sequence[str], rank_by: Column) -> DataFrame:
    """Rows per stratum and leading bits of the hash; written. At most 2**16 rows per stratum."""
    rank = F.shiftrightunsigned(rank_by.cast("long"), _RANK_BITS - _SLICE_BITS).alias("_slice")
    return materialize(df.groupBy(*strata, rank).agg(F.count(F.lit(1)).alias("_here")), "slices")


def stratum_sizes(counts: DataFrame, strata: Sequence[str]) -> DataFrame:
    return counts.groupBy(*strata).agg(F.sum("_here").alias("n"))


def _cut_slices(counts: DataFrame, strata: list[str], wanted: DataFrame) -> DataFrame:
    """Per stratum the slice that holds the `quota`-th row, how many of its rows are needed, and how many it has; written."""
    before = Window.partitionBy(*strata).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        counts.join(wanted.select(*strata, "quota"), strata)
        .withColumn("_before", F.coalesce(F.sum("_here").over(before), F.lit(0)))
        .where((F.col("_before") < F.col("quota")) & (F.col("quota") <= F.col("_before") + F.col("_here")))
    )
    needed = (F.col("quota") - F.col("_before")).alias("quota")
    return materialize(found.select(*strata, F.col("_slice").alias("_cut"), needed, F.col("_here").alias("_held")), "cuts")


def _last_rows(df: DataFrame, strata: list[str], ties: list[str], cuts: DataFrame) -> DataFrame:
    """Per stratum the place (rank, ties) of its last wanted row, and how many rows in that place are not wanted; written.

    The slice that the quota cuts is counted by further bits until it fits a
    task or no bits are left; only its rows are numbered.
    """
    limit, bits = window_rows(df.sparkSession), _SLICE_BITS
    while bits < _RANK_BITS and not cuts.where(F.col("_held") > limit).isEmpty():
        held = df.join(cuts.drop("_held"), strata).where(F.shiftrightunsigned("_rank", _RANK_BITS - bits) == F.col("_cut"))
        bits = min(_RANK_BITS, bits + _SLICE_BITS)
        counts = held.groupBy(*strata, F.shiftrightunsigned("_rank", _RANK_BITS - bits).alias("_slice"))
        cuts = _cut_slices(counts.agg(F.count(F.lit(1)).alias("_here")), strata, cuts)
    held = df.join(cuts, strata).where(F.shiftrightunsigned("_rank", _RANK_BITS - bits) == F.col("_cut"))
    places = held.groupBy(*strata, "_rank", *ties).agg(F.count(F.lit(1)).alias("_here"), F.first("quota").alias("_needed"))
    summed = running_sums(places.withColumn("_at", F.struct("_rank", *ties)), strata, "_at", ["_here"], descending=False)
    last = summed.where((F.col("cum__here") >= F.col("_needed")) & (F.col("cum__here") - F.col("_here") < F.col("_needed")))
    return materialize(last.select(*strata, F.col("_at").alias("_last"), (F.col("cum__here") - F.col("_needed")).alias("_over")), "last")


def take_quota(
    df: DataFrame,
    strata: Sequence[str],
    quotas: DataFrame,
    rank_by: Column,
    ties: Sequence[str],
    rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The `quota` rows with the smallest `rank_by` in every stratum, exactly.

    `rank_by` is a non-negative long spread over 63 bits. Rows are first counted
    by its leading bits (`counts`, if the caller has them already); the slice in
    which the last wanted row lies is refined until it fits a task, and that
    row's place is looked up in it. The sample is then one read of the rows, cut
    at that place: nothing is shuffled or numbered. Only where several rows
    share the place and not all are wanted these alone are numbered. `quotas`
    has one row per stratum, and strata are label values, so joins against it
    stay small. If `rows`, the size of `df`, is known to be within the window
    limit, strata are numbered directly.
    """
    strata, ties = list(strata), list(ties)
    if rows is not None and rows <= window_rows(df.sparkSession):
        turn = F.row_number().over(Window.partitionBy(*strata).orderBy(rank_by, *ties))
        numbered = df.withColumn("_turn", turn).join(quotas.select(*strata, "quota"), strata)
        return numbered.where(F.col("_turn") <= F.col("quota")).drop("_turn", "quota")
    counts = slice_counts(df, strata, rank_by) if counts is None else counts
    ranked = df.withColumn("_rank", rank_by.cast("long"))
    ties = [t for t in ties if t not in strata]
    last = _last_rows(ranked, strata, ties, _cut_slices(counts, strata, quotas))
    placed, at = ranked.join(last, strata), F.struct("_rank", *ties)
    if last.where(F.col("_over") > 0).isEmpty():
        return placed.where(at <= F.col("_last")).drop("_rank", "_last", "_over")
    shared = placed.where(at == F.col("_last"))
    many = shared.count()
    shared = sorted_places(shared, strata, [], "_turn", many)
    equals = shared.groupBy(*strata).agg(F.count(F.lit(1)).alias("_equal"))
    kept = shared.join(materialize(equals, "equals"), strata).where(F.col("_turn") < F.col("_equal") - F.col("_over"))
    out = placed.where(at < F.col("_last")).unionByName(kept.drop("_turn", "_equal"))
    return out.drop("_rank", "_last", "_over")


def case_split(
    df: DataFrame,
    keys: Sequence[str] = CASE_KEYS,
    within: Sequence[str] = (),
    test_size: float = 0.2,
    seed: int = SEED,
    rank_by: Column | None = None,
    label: str = "label",
) -> DataFrame:
    """Every flight with its label and `is_holdout`; stratified, exact sizes.

    The holdout has ceil(test_size * flights) flights per `within` group and the
    training part is shared over labels by largest remainder.
    """
    keys, within = list(keys), list(within)
    cases = materialize(case_labels(df, keys, label), "cases")
    sizes = cases.groupBy(*within, "case_label").agg(F.count(F.lit(1)).alias("n"))
    keep = F.col("_total") - F.ceil(F.col("_total") * F.lit(test_size))
    quotas = proportional_quotas(sizes, within, "case_label", keep)
    ranked = spread_hash(keys, seed) if rank_by is None else rank_by
    train = take_quota(cases, [*within, "case_label"], quotas, ranked, keys, cases.count())
    marked = train.select(*keys, F.lit(False).alias("is_holdout"))
    split = cases.join(marked, keys, "left").withColumn("is_holdout", F.coalesce("is_holdout", F.lit(True)))
    return materialize(split, "split")


def rows_of(df: DataFrame, cases: DataFrame, keys: Sequence[str] = CASE_KEYS) -> DataFrame:
    """Rows of the listed flights."""
    return df.join(cases.select(*keys), list(keys), "left_semi")


def stratified_sample(
    df: DataFrame,
    rows: int,
    ids: Sequence[str] = (*CASE_KEYS, ORDER),
    label: str = "label",
    seed: int = SEED,
    rank_by: Column | None = None,
) -> DataFrame:
    """Exactly `rows` rows with the label mix of the whole; an error if there are fewer."""
    ranked = spread_hash(ids, seed) if rank_by is None else rank_by
    counts = slice_counts(df, [label], ranked)
    quotas = proportional_quotas(stratum_sizes(counts, [label]), [], label, F.lit(rows))
    return take_quota(df, [label], quotas, ranked, ids, counts=counts)


def uniform_sample(
    df: DataFrame,
    rows: int,
    ids: Sequence[str] = (*CASE_KEYS, ORDER),
    seed: int = SEED,
    rank_by: Column | None = None,
) -> DataFrame:
    """Exactly `rows` rows without replacement; an error if there are fewer."""
    one, ranked = df.withColumn("_all", F.lit(0)), spread_hash(ids, seed) if rank_by is None else rank_by
    counts = slice_counts(one, ["_all"], ranked)
    quotas = stratum_sizes(counts, ["_all"]).select("_all", _at_most(F.lit(rows).cast("long"), F.col("n")).alias("quota"))
    return take_quota(one, ["_all"], quotas, ranked, ids, counts=counts).drop("_all")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight of every class: rows / (classes * rows of the class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return sizes.withColumn("weight", weight)


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds the balanced class weight to every row."""
    return df.join(materialize(class_weights(df, label).select(label, "weight"), "weights"), label)
