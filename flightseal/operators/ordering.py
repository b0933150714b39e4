"""Order-dependent work inside a flight without putting a long flight in one task.

A window needs all rows of its partition in one task. Flights of ordinary
length are one window partition each. If some flight has more rows than the
limit, those flights are cut into blocks of consecutive rows, and every block receives extra *context* rows that carry what it needs to know about the
rows outside it: a running count, a fill value, or the last few rows before it.
After the windows the context rows are dropped, so results equal the uncut
window.

Whether any flight is long is looked up first, from the key columns alone, so
the common case keeps the plain one-exchange plan. Context tables hold a few
rows per block and are written out, so the main plan reads its input once.

Blocks are cut by counted rows, not by order values: the rows of long flights
are sorted by (order value, ties, content) and numbered, and every `limit` of
them are a block. So repeated, sparse or NULL order values make no block larger
or smaller. Where order values repeat, the columns named as `ties` decide; rows
that are equal in these too are in the order of a hash of their content if
their flight is cut, in any order otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize, window_rows
from .numbering import same_keys, sorted_places

BLOCK = "_block"
PLACE = "_place"
LONG = "_long"
CONTEXT = "_context"


@dataclass
class Flights:
    """Rows ready for per-flight windows, cut where a flight is long."""

    rows: DataFrame
    keys: list[str]
    order: str
    ties: Sequence[str] = ()
    cut: bool = False
    contexts: list[DataFrame] = field(default_factory=list)

    @property
    def part(self) -> list[str]:
        return [*self.keys, BLOCK] if self.cut else self.keys

    @property
    def long_rows(self) -> DataFrame:
        return self.rows.where(F.col(LONG))

    def window(self) -> WindowSpec:
        """Context rows without an order value and a place come first."""
        along = [self.order, *([PLACE] if self.cut else []), *self.ties]
        return Window.partitionBy(*self.part).orderBy(*[F.col(c).asc_nulls_first() for c in along])

    def add(self, context: DataFrame) -> None:
        self.contexts.append(materialize(context, "context"))

    def with_context(self) -> DataFrame:
        out = self.rows
        if self.cut:
            out = out.withColumn(CONTEXT, F.lit(False))
            for context in self.contexts:
                out = out.unionByName(context.withColumn(CONTEXT, F.lit(True)), allowMissingColumns=True)
        return out

    def real(self, rows: DataFrame, *helpers: str) -> DataFrame:
        if self.cut:
            rows = rows.where(~F.col(CONTEXT)).drop(CONTEXT, BLOCK, LONG, PLACE)
        return rows.drop(*helpers)

    def earlier_blocks(self) -> WindowSpec:
        """Frame over the blocks before this one, on a one-row-per-block table."""
        return Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    def all_blocks(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )

    def preceding_rows(self, depth: int, columns: Sequence[str]) -> DataFrame:
        """The last `depth` rows before every block, tagged with that block.

        Only the last `depth` rows of a block can matter to a later one; the
        row_number filter becomes a group limit ahead of the shuffle.
        """
        from_end = Window.partitionBy(*self.keys, BLOCK).orderBy(F.col(PLACE).desc())
        tails = (
            self.long_rows.select(*self.keys, self.order, PLACE, *columns, BLOCK)
            .withColumn("_from_end", F.row_number().over(from_end))
            .where(F.col("_from_end") <= depth)
            .drop("_from_end")
        )
        along = Window.partitionBy(*self.keys).orderBy(PLACE)
        ahead = {f"_next_{step}": F.lead(BLOCK, step).over(along) for step in range(1, depth + 1)}
        return (
            tails.withColumns(ahead)
            .withColumn("_target", F.explode(F.array_distinct(F.array(*ahead))))
            .where(F.col("_target") > F.col(BLOCK))
            .withColumn(BLOCK, F.col("_target"))
            .drop("_target", *ahead)
        )


def flights(
    df: DataFrame, keys: Sequence[str], order: str, limit: int | None = None, ties: Sequence[str] = ()
) -> Flights:
    """Look up long flights and cut them.

    A flight is listed only if it has more than `limit` rows, so the list has
    fewer than total_rows / limit entries; it is written out, and the planner
    broadcasts it only if its file size allows. Rows of listed flights are
    sorted and written; a block has `limit` of them, the last one of a flight
    what is left.
    """
    keys = list(keys)
    limit = limit or window_rows(df.sparkSession)
    long_flights = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > limit)
        .select(*[F.col(k).alias(f"_long_{k}") for k in keys], F.lit(True).alias(LONG), "_rows")
    )
    listed = materialize(long_flights, "long")
    long_total = listed.agg(F.sum("_rows")).first()[0]
    if not long_total:
        return Flights(df, keys, order, ties)
    same = same_keys(keys, [f"_long_{k}" for k in keys])  # a NULL key is a flight too
    marked = df.join(listed.drop("_rows"), same, "left").drop(*[f"_long_{k}" for k in keys])
    along = [F.col(c).asc_nulls_first() for c in (order, *ties)]
    placed = sorted_places(marked.where(F.col(LONG)), keys, along, PLACE, long_total)
    placed = placed.withColumn(BLOCK, F.floor(F.col(PLACE) / F.lit(limit)).cast("long"))
    whole = marked.where(F.col(LONG).isNull()).withColumns({PLACE: F.lit(None).cast("long"), BLOCK: F.lit(0).cast("long")})
    return Flights(whole.unionByName(placed), keys, order, ties, cut=True)


def with_position(
    df: DataFrame, keys: Sequence[str], order: str, name: str, limit: int | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """Adds the 0-based position of every row within its flight."""
    data = flights(df, keys, order, limit, ties)
    if data.cut:
        counts = data.long_rows.groupBy(*data.part).agg(F.count(F.lit(1)).alias("_here"))
        before = F.coalesce(F.sum("_here").over(data.earlier_blocks()), F.lit(0))
        data.add(counts.select(*data.part, before.alias("_step")))
    data.rows = data.rows.withColumn("_step", F.lit(1).cast("long"))
    so_far = data.window().rowsBetween(Window.unboundedPreceding, 0)
    rows = data.with_context().withColumn(name, F.sum("_step").over(so_far) - 1)
    return data.real(rows, "_step")


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], limit: int | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """Adds the previous row's value of `columns` under the given names."""
    data = flights(df, keys, order, limit, ties)
    if data.cut:
        data.add(data.preceding_rows(1, list(columns)))
    lagged = {new: F.lag(old).over(data.window()) for old, new in columns.items()}
    return data.real(data.with_context().withColumns(lagged))


def filled(
    df: DataFrame, keys: Sequence[str], order: str, column: str, limit: int | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """Fill missing values forward, then leading ones backward, within a flight."""
    data = flights(df, keys, order, limit, ties)
    if data.cut:
        at = F.when(F.col(column).isNotNull(), F.col(PLACE))
        edges = data.long_rows.groupBy(*data.part).agg(
            F.max_by(column, at).alias("_last"), F.min_by(column, at).alias("_first")
        )
        data.add(
            edges.select(
                *data.part,
                F.last("_last", ignorenulls=True).over(data.earlier_blocks()).alias(column),
                F.first("_first", ignorenulls=True).over(data.all_blocks()).alias("_opening"),
            )
        )
    data.rows = data.rows.withColumn("_opening", F.lit(None).cast(df.schema[column].dataType))
    window = data.window()
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = F.coalesce(
        F.last(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)),
        F.first(column, ignorenulls=True).over(whole),
        F.first("_opening", ignorenulls=True).over(whole),
    )
    rows = data.with_context().withColumn("_value", value)
    return data.real(rows, column, "_opening").withColumnRenamed("_value", column)
