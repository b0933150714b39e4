"""Distributed LSD radix sort: ranks of rows by a composite key of whole numbers.

Rows lie in blocks of equal size. A pass counts each digit per block; the
prefix sums of these counts, by digit and then by block, are where the rows of
a digit and block begin, and a row goes there in the order it had. Passes go
from the lowest digit to the highest, so each keeps what those before it
sorted; after the last a row's place is its rank. A pass moves each row once,
and no task holds more than a block of one digit, however often a key repeats.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import chunks_for, unused

DIGIT_BITS = 11
BLOCK_ROWS = 1 << 18
_SIGN = -(1 << 63)


@dataclass
class Field:
    """An unsigned number of `bits` bits, as the bits of a long."""

    value: Column
    bits: int


def fields(rows: DataFrame, order: Sequence[tuple[str, bool]]) -> list[Field]:
    """The composite key, lowest field first. order: whole-number columns, first decides, and whether they descend.

    Nulls come last. A column has as many bits as tell its smallest value from its largest.
    """
    found = rows.agg(*[f(F.col(c).cast("long")) for c, _ in order for f in (F.min, F.max, lambda x: F.count_if(x.isNull()))]).first()
    out = []
    for i, (name, falls) in reversed(list(enumerate(order))):
        low, high, nulls = found[3 * i : 3 * i + 3]
        value = F.col(name).cast("long")
        if low is not None and high > low:
            if high - low < 1 << 63:
                value, bits = (F.lit(high) - value if falls else value - F.lit(low)), (high - low).bit_length()
            else:  # the difference does not fit: the unsigned order of the bits themselves
                value = value.bitwiseXOR(F.lit(_SIGN))
                value, bits = (F.bitwise_not(value) if falls else value), 64
            out.append(Field(F.coalesce(value, F.lit(0)), bits))
        if nulls:
            out.append(Field(F.col(name).isNull().cast("long"), 1))
    return out


def digits(key: Sequence[Field], bits: int = DIGIT_BITS) -> list[Column]:
    """The digits of the composite key, lowest first; one may hold the end of a field and the start of the next."""
    out, begin = [], 0
    ends = [sum(f.bits for f in key[: i + 1]) for i in range(len(key))]
    while ends and begin < ends[-1]:
        digit = F.lit(0)
        for field, end in zip(key, ends):
            first = end - field.bits
            low, high = max(first, begin), min(end, begin + bits)
            if low < high:
                part = F.shiftrightunsigned(field.value, low - first).bitwiseAND(F.lit((1 << (high - low)) - 1))
                digit = digit + F.shiftleft(part, low - begin)
        out.append(digit.cast("int"))
        begin += bits
    return out


def ranked(rows: DataFrame, order: Sequence[tuple[str, bool]], name: str, digit_bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `name`: 1, 2, 3 ... by `order` (see `fields`) to a written table; a column of that name is replaced.

    Rows with equal keys are ranked by the hash of all columns; rows that are
    equal in all get a rank each. An empty table stays empty. Every pass is
    written, so its places stay as they are when executors are lost.
    """
    rows = rows.drop(name)
    total = rows.count()
    block, at, digit, count, start = unused(rows.columns, "block", "place", "digit", "rows", "start")
    mixed = F.xxhash64(*rows.columns)
    now = rows.withColumn(block, F.pmod(mixed, F.lit(chunks_for(total, block_rows)))).withColumn(at, mixed)
    passes = digits(fields(rows, order), digit_bits) or [F.lit(0)]
    for number, value in enumerate(passes):
        dealt = now.withColumn(digit, value)
        counts = dealt.groupBy(digit, block).agg(F.count(F.lit(1)).alias(count))
        before = Window.orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)  # a row per digit
        bases = counts.groupBy(digit).agg(F.sum(count).alias(count)).select(digit, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start))
        inside = Window.partitionBy(digit).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.join(bases, digit).select(digit, block, (F.col(start) + F.coalesce(F.sum(count).over(inside), F.lit(0))).alias(start))
        own = F.row_number().over(Window.partitionBy(digit, block).orderBy(at)) - 1
        moved = dealt.withColumn(count, own).join(starts, [digit, block])
        place = (F.col(start) + F.col(count)).cast("long")
        now = materialize(moved.select(*rows.columns, F.floor(place / block_rows).alias(block), place.alias(at)), f"radix-{number}")
    return now.select(*rows.columns, (F.col(at) + 1).alias(name))
