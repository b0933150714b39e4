"""Foreign flight logs in the internal schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    COLUMN_CANDIDATES,
    DEFAULT_PHASE,
    PHASE_CANDIDATES,
    TIMESTAMP_CANDIDATES,
    TITLE_CANDIDATES,
)
from ..functions.convert import to_number
from .ordering import filled


def named(name: str) -> Column:
    """A column by its literal name, dots and brackets included."""
    return F.col("`" + name.replace("`", "``") + "`")


def find_column(columns: Sequence[str], candidates: Sequence[str], purpose: str) -> str:
    """The first candidate that exists, compared exactly."""
    for candidate in candidates:
        if candidate in columns:
            return candidate
    raise ValueError(
        f"no column for '{purpose}': tried {list(candidates)}, available columns are {list(columns)}"
    )


def log_timestamp(columns: Sequence[str], cell: Callable[[str], Column] = named) -> Column:
    """Epoch or relative milliseconds as a timestamp."""
    millis = to_number(cell(find_column(columns, TIMESTAMP_CANDIDATES, "timestamp")))
    return F.timestamp_micros(F.round(millis * 1000.0).cast("long"))


def phase_column(columns: Sequence[str]) -> str | None:
    return next((c for c in PHASE_CANDIDATES if c in columns), None)


def title_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in TITLE_CANDIDATES if c in columns]


def internal_columns(columns: Sequence[str], cell: Callable[[str], Column] = named) -> dict[str, Column]:
    """Timestamp, measured values and phase of a log that has these columns; `cell` gives a column by its name."""
    out = {"timestamp": log_timestamp(columns, cell)}
    for name, candidates in COLUMN_CANDIDATES.items():
        out[name] = to_number(cell(find_column(columns, candidates, name)))
    phase = phase_column(columns)
    return out | {"phase": cell(phase).cast("string") if phase else F.lit(DEFAULT_PHASE)}


def adapt_log(
    raw: DataFrame,
    keys: Sequence[str] = ("case_id",),
    order: str = "row_idx",
    extra: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Internal schema of a log export with any known header.

    `raw` must carry its flight key and row position (the log reader adds both).
    Numbers that do not parse become missing; the phase is filled forward, then
    backward, and is constant where the log has none.
    """
    columns = raw.columns
    values = [value.alias(name) for name, value in internal_columns(columns).items()]
    out = raw.select(*keys, F.col(order), *extra, *values, *[named(c).alias(c) for c in title_columns(columns)])
    return filled(out, keys, order, "phase", limit) if phase_column(columns) else out
