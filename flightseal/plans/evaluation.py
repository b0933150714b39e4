"""Row, flight and type tables from scored rows, for every replicate and model in one job.

A scored table is long: one row per telemetry row and model with `model` and
`score`, plus flight keys, `profile`, `label`, `tamper_type` and `case_name`.
`by` names the columns that separate repetitions of the protocol, usually
("replicate",) or ().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.casewise import case_scores, case_types, per_type_cases, per_type_rows
from ..operators.ranking import best_thresholds, metrics_table, ranked_scores
from ..session import materialize

HOLDOUT = "balanced_holdout"
TRAINED_ON = "balanced"


def long_scores(wide: DataFrame, models: dict[str, str]) -> DataFrame:
    """One row per (row, model) from score columns; `models` maps column to model name."""
    entries = [F.struct(F.lit(name).alias("model"), F.col(c).cast("double").alias("score")) for c, name in models.items()]
    return wide.select(*[c for c in wide.columns if c not in models], F.inline(F.array(*entries)))


def with_dataset(df: DataFrame, split: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `dataset`: holdout flights of the training profile, all flights of the others.

    Training flights are left out. `split` has one row per flight with `is_holdout`.
    """
    held = split.where(F.col("is_holdout")).select(*keys, F.lit(True).alias("_held"))
    marked = df.join(held, list(keys), "left")
    name = F.when(F.col("profile") != TRAINED_ON, F.col("profile")).when(F.col("_held"), HOLDOUT)
    return marked.withColumn("dataset", name).where(F.col("dataset").isNotNull()).drop("_held")


def rank(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts of every (repetition, dataset, model), the base of all metrics."""
    return ranked_scores(scored, [*by, "dataset", "model"])


def tune(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 threshold of every model, tuned on the holdout."""
    held = ranked.where(F.col("dataset") == HOLDOUT)
    return materialize(best_thresholds(held, [*by, "model"]), "thresholds")


def metrics(ranked: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The metric record of every (repetition, dataset, model)."""
    return metrics_table(ranked, [*by, "dataset", "model"], thresholds, [*by, "model"])


def _flight(scored: DataFrame, by: Sequence[str], case: str) -> list[str]:
    """What tells flights apart besides `by`: replicates may number theirs alike."""
    return [c for c in ("replicate",) if c in scored.columns and c not in by] + [case]


def flights_of(scored: DataFrame, by: Sequence[str] = (), case: str = "case_id") -> DataFrame:
    """One row per flight and model with its highest label and score.

    Ranked, tuned and measured like rows, this gives the flight-level table.
    """
    return case_scores(scored, [*by, "dataset", "model", *_flight(scored, by, case)])


def type_rows(scored: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Types against normal rows on the untouched profiles."""
    untouched = scored.where(F.col("dataset") != HOLDOUT)
    return per_type_rows(untouched, [*by, "dataset", "model"], thresholds, [*by, "model"])


def type_cases(
    scored: DataFrame, thresholds: DataFrame, by: Sequence[str] = (), case: str = "case_id"
) -> DataFrame:
    """Flagged flights by type on the untouched profiles."""
    untouched = scored.where(F.col("dataset") != HOLDOUT)
    keys = [*by, "dataset", "model"]
    return per_type_cases(case_types(untouched, [*keys, *_flight(scored, by, case)]), keys, thresholds, [*by, "model"])
