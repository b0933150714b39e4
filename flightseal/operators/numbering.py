"""Places of rows in an order, without a window over them.

Rows are cut into ranges of about equal row count, sorted and written, a range
per task; a task numbers its rows while it writes them. What is left to add up
is one count per key and range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import DEFAULT_WINDOW_ROWS, materialize, window_rows

#: monotonically_increasing_id has the task's number above these bits and counts rows below them.
_TICK_BITS = 33


def content_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed; rows that differ in one of them hardly ever share it."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """Names for helper columns that none of `columns` has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """NULL keys are equal to each other; no keys: always."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)], F.lit(True))


def sorted_places(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, rows: int) -> DataFrame:
    """Adds `name`: the place, from 0, of every row among those of its keys; the rows are written, sorted.

    rows: how many there are, about. Rows with equal order are told apart by
    their content; rows that are equal in all have places one after the other,
    and as it makes no difference which has which, a task that runs again
    changes nothing. Ranges follow the rows, not the keys, so a key may hold any
    share of them.
    """
    keys, spark = list(keys), df.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    per_task = min(window_rows(spark), DEFAULT_WINDOW_ROWS)
    ranges = max(1, min(math.ceil(rows / per_task), max(shuffled, math.ceil(rows / DEFAULT_WINDOW_ROWS))))
    along = [*[F.col(k) for k in keys], *order, content_hash(df)]
    tick, part, here, first, start = unused(df.columns, "_tick", "_part", "_here", "_first", "_start")
    cut = df.repartitionByRange(ranges, *along).sortWithinPartitions(*along)
    placed = materialize(cut.withColumn(tick, F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn(part, F.shiftright(tick, _TICK_BITS))
    counts = placed.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(here), F.min(tick).alias(first))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(start, F.coalesce(F.sum(here).over(before), F.lit(0)))
    renamed = unused([*df.columns, tick, part, first, start], *[f"_of_{k}" for k in [*keys, "part"]])
    starts = starts.select(*[F.col(k).alias(n) for k, n in zip([*keys, part], renamed)], first, start)
    found = placed.join(materialize(starts, "starts"), same_keys([*keys, part], renamed))
    return found.select(*df.columns, (F.col(start) + F.col(tick) - F.col(first)).alias(name))
