"""Running sums along one global order, spread over many tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, window_rows
from .numbering import sorted_places, unused

_TOP, _PLACE = "_top", "_place_in_order"


def running_sums(
    counts: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    descending: bool = True,
    depth: int | None = None,
) -> DataFrame:
    """Adds `cum_<c>` and `total_<c>` for every column in `sums` (whole numbers), along `order` within `keys`.

    `counts` holds one row per (keys, order), so however many input rows share a
    value they are already one row here. It is written out, because it is read
    more than once, and its row count picks the plan. Up to the window limit the
    window runs per `keys`. Beyond it the rows are sorted and numbered, and every
    `limit` of a key's rows are a range of their own; sums of whole ranges are
    carried in by one extra row per range. The ranges' own sums are running sums
    again, so where there are too many ranges for a task they are cut into
    ranges of ranges. No window holds more than `limit` rows, however many
    values there are. `depth` forces a plan: 0 is the plain window, d cuts the
    rows into about 2**d ranges.
    """
    keys, sums = list(keys), list(sums)
    limit = window_rows(counts.sparkSession)
    counts = materialize(counts, "counts")
    along = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first()
    rows = counts.count() if depth != 0 else 0
    if depth == 0 or depth is None and rows <= limit:
        window = Window.partitionBy(*keys).orderBy(along)
        so_far = window.rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        return counts.withColumns(
            {f"cum_{c}": F.sum(c).over(so_far) for c in sums} | {f"total_{c}": F.sum(c).over(whole) for c in sums}
        )

    [own] = unused(counts.columns, "_range")
    size = limit if depth is None else max(1, math.ceil(rows / (1 << depth)))
    placed = sorted_places(counts, keys, [along], _PLACE, rows)
    ranged = placed.withColumn(own, F.floor(F.col(_PLACE) / size)).drop(_PLACE)
    totals = ranged.groupBy(*keys, own).agg(*[F.sum(c).alias(c) for c in sums])
    carried = running_sums(totals, keys, own, sums, descending=False).select(
        *keys,
        own,
        F.lit(True).alias(_TOP),
        *[(F.col(f"cum_{c}") - F.col(c)).alias(c) for c in sums],
        *[f"total_{c}" for c in sums],
    )
    rows = ranged.withColumn(_TOP, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    window = (
        Window.partitionBy(*keys, own)
        .orderBy(F.col(_TOP).desc(), along)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = {f"cum_{c}": F.sum(c).over(window) for c in sums}
    summed |= {f"total_{c}": F.first(f"total_{c}").over(window) for c in sums}
    return rows.withColumns(summed).where(~F.col(_TOP)).drop(_TOP, own)
