"""Data audit of a telemetry table, for all groups (profiles, replicates) at once.

`groups` are the columns that tell tables apart; flights are `groups` +
`case_id`. Each measure is one aggregate; only the time-order measures need a
window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import GAP_S, ORDER
from ..functions.convert import holds
from ..functions.kinematics import seconds_between
from ..session import materialize
from .numbering import same_keys
from .ordering import with_previous

#: Logarithm of the registers of a flight sketch.
SKETCH_BITS = 14
#: Logarithm of the most bits in a map of repeated hashes.
MAP_BITS = 30
ROW_IDENTITY = ("case_id", "row_idx", "original_row_idx")


def summary(df: DataFrame, groups: Sequence[str] = (), case: str = "case_id", labels: Sequence[int] = ()) -> DataFrame:
    """Rows, anomaly rate, flights, time range and epoch-sentinel rows; also `label_<l>_rows` of the given labels."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col("label").cast("double")).alias("anomaly_rate"),
        F.count_distinct(F.col(case)).alias("cases"),
        F.min("timestamp").alias("ts_min"),
        F.max("timestamp").alias("ts_max"),
        F.count_if(F.year("timestamp") <= 1971).alias("epoch_rows"),
        *[F.count_if(F.col("label") == value).alias(f"label_{value}_rows") for value in labels],
    )


def case_sketches(df: DataFrame, parts: Sequence[str] = ("profile", "replicate"), case: str = "case_id", log2_size: int = SKETCH_BITS) -> DataFrame:
    """Rows and a sketch of the flights of every part. Parts merge, so a new replicate is added without a read of the others."""
    flight = F.xxhash64(*parts, case)
    return df.groupBy(*parts).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(flight, log2_size).alias("case_sketch"))


def approximate_cases(sketched: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rows and flights per group from the sketches of its parts: no shuffle of flights, and a stated error.

    Of many counts two in three are off by less than 1.04 / sqrt(2 ** log2_size), 0.8 percent as `case_sketches` makes them.
    """
    merged = F.hll_sketch_estimate(F.hll_union_agg("case_sketch"))
    return sketched.groupBy(*groups).agg(F.sum("rows").alias("rows"), merged.alias("cases"))


def label_counts(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups, "label").agg(F.count(F.lit(1)).alias("rows"))


def case_label_counts(df: DataFrame, groups: Sequence[str] = (), case: str = "case_id") -> DataFrame:
    """Flights per flight label (a flight is 1 if any of its rows is)."""
    cases = df.groupBy(*groups, case).agg(F.max("label").alias("case_label"))
    return cases.groupBy(*groups, "case_label").agg(F.count(F.lit(1)).alias("cases"))


def type_cases(df: DataFrame, groups: Sequence[str] = (), case: str = "case_id") -> DataFrame:
    """Flights in which each type occurs."""
    return df.groupBy(*groups, "tamper_type").agg(F.count_distinct(F.col(case)).alias("cases"))


def missing(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Missing values per column, only columns that have any."""
    names = [c for c in df.columns if c not in groups]
    counted = df.groupBy(*groups).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counted.unpivot(list(groups), names, "column", "missing").where(F.col("missing") > 0)


def time_order(
    df: DataFrame, groups: Sequence[str] = (), case: str = "case_id", order: str = ORDER, limit: int | None = None
) -> DataFrame:
    """Share of backward steps over all rows, largest gap, and gaps above a minute."""
    keys = [*groups, case]
    timed = with_previous(df.select(*keys, order, "timestamp"), keys, order, {"timestamp": "_before"}, limit)
    delta = seconds_between(F.col("timestamp"), F.col("_before"))
    return (
        timed.withColumn("_delta", delta)
        .groupBy(*groups)
        .agg(
            (F.count_if(holds(F.col("_delta") < 0)) / F.count(F.lit(1))).alias("ts_decrease_frac"),
            F.max("_delta").alias("ts_max_gap_s"),
            F.count_if(holds(F.col("_delta") > GAP_S)).alias("ts_gaps_gt_60s"),
        )
    )


def repeated_places(
    df: DataFrame, groups: Sequence[str] = (), case: str = "case_id", order: str = ORDER
) -> DataFrame:
    """Rows whose order value is NULL or occurred before in their flight, and flights that have such rows.

    Features look at the rows before a row; where this is not 0, name the columns that decide among such rows.
    """
    keys = [*groups, case]
    places = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_rows"))
    missing_ = F.when(F.col(order).isNull(), F.col("_rows")).otherwise(0)
    again = F.when(F.col(order).isNotNull(), F.col("_rows") - 1).otherwise(0)
    cases = places.groupBy(*keys).agg(F.sum(missing_).alias("_missing"), F.sum(again).alias("_again"))
    return cases.groupBy(*groups).agg(
        F.sum("_again").alias("repeated_places"),
        F.sum("_missing").alias("missing_places"),
        F.count_if((F.col("_again") > 0) | (F.col("_missing") > 0)).alias("cases_with_unclear_order"),
    )


def _repeated_hashes(df: DataFrame, groups: Sequence[str], mark: Column) -> tuple[DataFrame, int]:
    """(_bucket, _bits): a bit map of the hashes that occur more than once, about a sixteenth of it set, and its number of bits.

    Of the rows only groups and hash are moved. A map has at most 2**MAP_BITS bits, a row per 2**15 of them.
    """
    counted = df.select(*groups, mark.alias("_mark")).groupBy(*groups, "_mark").agg(F.count(F.lit(1)).alias("_here"))
    repeated = materialize(counted.where(F.col("_here") > 1).select("_mark"), "repeated")
    bits = min(1 << MAP_BITS, max(1 << 15, 1 << (16 * repeated.count()).bit_length()))
    place = F.pmod("_mark", F.lit(bits))
    number, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    return materialize(repeated.groupBy(number.alias("_bucket")).agg(F.bitmap_construct_agg(at).alias("_bits")), "hash-map"), bits


def possible_twins(df: DataFrame, groups: Sequence[str], content: Sequence[str]) -> DataFrame:
    """All rows whose content may occur again in their group, and few others. Rows are only filtered where they lie.

    The map of repeated hashes goes to every task: it is at most 2**MAP_BITS bits, 128 MB, whatever the input.
    """
    mark = F.xxhash64(*groups, *content)
    marks, bits = _repeated_hashes(df, groups, mark)
    place = F.pmod(mark, F.lit(bits))
    at = F.bitmap_bit_position(place)
    placed = df.withColumns({"_bucket": F.bitmap_bucket_number(place), "_at": at})
    joined = placed.join(F.broadcast(marks), "_bucket")
    held = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1
    return joined.withColumn("_byte", held).where(set_).select(*df.columns)


def duplicates(
    df: DataFrame, groups: Sequence[str] = (), identity: Sequence[str] = ROW_IDENTITY
) -> DataFrame:
    """Exact duplicate rows, and duplicates when the row identity is ignored.

    Hashes of the content find the rows that can have a twin; only these are
    moved and compared in all columns. Equal copies are counted by all columns
    before that shuffle, and those counts are added up by the columns of the content.
    """
    content = [c for c in df.columns if c not in identity and c not in groups]
    rest = [c for c in df.columns if c in identity and c not in groups]
    rows = possible_twins(df, groups, content)
    copies = rows.groupBy(*groups, *content, *rest).agg(F.count(F.lit(1)).alias("_copies"))
    alike = copies.groupBy(*groups, *content).agg(
        F.sum("_copies").alias("_alike"), F.sum(F.col("_copies") - 1).alias("_exact")
    )
    found = alike.groupBy(*groups).agg(F.sum("_exact").alias("_exact"), F.sum(F.col("_alike") - 1).alias("_again"))
    every = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"))
    renamed = [f"_of_{g}" for g in groups]
    found = found.withColumnsRenamed(dict(zip(groups, renamed)))
    told = every.join(found, same_keys(groups, renamed), "left")
    count = lambda name: F.when(F.col("_rows") > 0, F.coalesce(name, F.lit(0)))
    return told.select(
        *groups, count("_exact").alias("exact_duplicate_rows"), count("_again").alias("duplicate_rows_ignoring_idx")
    )


def audit(
    df: DataFrame, groups: Sequence[str] | None = None, case: str = "case_id", limit: int | None = None
) -> DataFrame:
    """One record per group with all measures, counts as maps, ready for a JSON sink.

    `groups` defaults to the profile and the replicate, where there are such
    columns: replicates may number their flights alike.
    """
    groups = [c for c in ("profile", "replicate") if c in df.columns] if groups is None else list(groups)

    def as_map(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))
        return table.groupBy(*groups).agg(F.map_from_entries(entries).alias(name))

    out = summary(df, groups, case).withColumns(
        {
            "anomaly_rate": F.bround("anomaly_rate", 5),
            "ts_min": F.col("ts_min").cast("string"),
            "ts_max": F.col("ts_max").cast("string"),
        }
    )
    timing = time_order(df, groups, case, limit=limit).withColumns(
        {"ts_decrease_frac": F.bround("ts_decrease_frac", 6), "ts_max_gap_s": F.bround("ts_max_gap_s", 3)}
    )
    maps = [
        as_map(label_counts(df, groups), "label", "rows", "label_counts"),
        as_map(case_label_counts(df, groups, case), "case_label", "cases", "case_label_counts"),
        as_map(type_cases(df, groups, case), "tamper_type", "cases", "tamper_type_cases"),
        as_map(missing(df, groups), "column", "missing", "missing"),
    ]
    for part in (*maps, timing, duplicates(df, groups)):
        out = out.join(part, groups, "left")
    return out
