"""Ranking and threshold metrics for any number of score groups in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sums

# Added to precision + recall so that an all-wrong point has F1 0.
F1_GUARD = 1e-12

METRICS = ("roc_auc", "pr_auc", "f1", "prec", "rec", "bal_acc", "mcc")


def ranked_scores(
    df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score", depth: int | None = None
) -> DataFrame:
    """One row per group and distinct score with counts at and above that score."""
    counts = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    return running_sums(counts, keys, "score", ["pos", "n"], depth=depth)


def pr_curve(ranked: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 of the rule `score >= this score`."""
    curve = ranked.withColumns(
        {
            "precision": F.col("cum_pos") / F.col("cum_n"),
            "recall": F.when(F.col("total_pos") == 0, 1.0).otherwise(
                F.try_divide(F.col("cum_pos"), F.col("total_pos"))
            ),
        }
    )
    both = F.col("precision") + F.col("recall")
    return curve.withColumn("f1", F.col("precision") * 2.0 * F.col("recall") / (both + F1_GUARD))


def best_thresholds(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lowest score among those with the highest F1, per group."""
    best = F.max(F.struct(F.col("f1"), (-F.col("score")).alias("lowest")))
    return pr_curve(ranked).groupBy(*keys).agg((-best.getField("lowest")).alias("threshold"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _ranking_aggregates() -> list[Column]:
    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    negatives_to_here = (F.col("cum_n") - F.col("cum_pos")).cast("double")
    return [
        F.sum("n").alias("n"),
        F.sum("pos").alias("pos"),
        F.sum(pos * F.col("cum_pos") / F.col("cum_n")).alias("_precision_steps"),
        F.sum(pos * (negatives_to_here - neg * 0.5)).alias("_inversions"),
    ]


def _ranking_columns() -> dict[str, Column]:
    pos = F.col("pos").cast("double")
    pairs = pos * (F.col("n") - F.col("pos")).cast("double")
    return {
        "pr_auc": _ratio(F.col("_precision_steps"), pos),
        "roc_auc": F.lit(1.0) - F.try_divide(F.col("_inversions"), pairs),
    }


def ranking_quality(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, pos, step-sum average precision and ROC-AUC (NULL for a single class) per group."""
    summed = ranked.groupBy(*keys).agg(*_ranking_aggregates())
    return summed.withColumns(_ranking_columns()).drop("_precision_steps", "_inversions")


def _threshold_columns() -> dict[str, Column]:
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    fn, tn = pos - tp, neg - fp
    sensitivity, specificity = F.try_divide(tp, pos), F.try_divide(tn, neg)
    classes = sensitivity.isNotNull().cast("int") + specificity.isNotNull().cast("int")
    scale = F.sqrt(tp + fp) * F.sqrt(pos) * F.sqrt(neg) * F.sqrt(tn + fn)
    return {
        "f1": _ratio(tp * 2.0, tp + fp + pos),
        "prec": _ratio(tp, tp + fp),
        "rec": _ratio(tp, pos),
        "bal_acc": (F.coalesce(sensitivity, F.lit(0.0)) + F.coalesce(specificity, F.lit(0.0))) / classes,
        "mcc": _ratio(tp * tn - fp * fn, scale),
    }


def threshold_metrics(
    df: DataFrame, keys: Sequence[str], threshold: Column, label: str = "label", score: str = "score"
) -> DataFrame:
    """n, pos and the confusion-count metrics of `score >= threshold`, one aggregate."""
    flagged = F.col(score) >= threshold
    actual = F.col(label) == 1
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(actual).alias("pos"),
        F.count_if(flagged & actual).alias("tp"),
        F.count_if(flagged & ~actual).alias("fp"),
    )
    return counted.withColumns(_threshold_columns())


def metrics_table(ranked: DataFrame, keys: Sequence[str], thresholds: DataFrame, on: Sequence[str]) -> DataFrame:
    """The full metric record of every group in one job.

    `thresholds` has one row per `on` group. Pass it written out, so that the
    planner knows its size when it picks the join. A group without a threshold
    keeps its ranking measures; its threshold measures are NULL.
    """
    at = ranked.join(thresholds.select(*on, "threshold"), list(on), "left")
    flagged = F.col("score") >= F.col("threshold")
    unknown = F.when(F.col("threshold").isNull(), F.lit(None))
    counted = at.groupBy(*keys).agg(
        *_ranking_aggregates(),
        F.sum(unknown.when(flagged, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(unknown.when(flagged, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
    )
    full = counted.withColumns(_ranking_columns() | _threshold_columns())
    return full.select(*keys, "n", "pos", *METRICS)


def rounded(table: DataFrame, names: Sequence[str] = METRICS, digits: int = 4) -> DataFrame:
    """Half-even rounding of the named columns, as metric tables are published."""
    return table.withColumns({name: F.bround(name, digits) for name in names})
