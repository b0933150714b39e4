"""Summaries over replicates and report tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NORMAL, STATIONARY_MPS, TITLE_CANDIDATES
from ..functions.convert import holds

# Display names, in display order.
DATASET_LABELS = {"balanced_holdout": "Balanced holdout", "strong": "Strong", "subtle": "Subtle"}
MODEL_LABELS = {
    "GradientBoosting": "Gradient Boosting",
    "RBF-SVC": "RBF SVM",
    "LinearSVC": "Linear SVM",
    "GradientBoosting-transfer": "GB (transfer)",
}


def stack_results(*tables: DataFrame) -> DataFrame:
    """Union of result tables; columns a table lacks are missing in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def summarise(
    results: DataFrame, by: Sequence[str], metrics: Sequence[str], means: Sequence[str] = ()
) -> DataFrame:
    """Mean and population deviation per metric, as numbers and as `mean ± std` text."""
    spread = [F.avg(m).alias(f"{m}_mean") for m in metrics] + [F.stddev_pop(m).alias(f"{m}_std") for m in metrics]
    table = results.groupBy(*by).agg(*spread, *[F.avg(m).alias(m) for m in means])
    return table.withColumns(
        {m: F.concat(fixed(F.col(f"{m}_mean"), 4), F.lit(" ± "), fixed(F.col(f"{m}_std"), 4)) for m in metrics}
    )


def pivot_metric(
    results: DataFrame, index: Sequence[str], column: str, values: Sequence, metric: str
) -> DataFrame:
    """One column per value of `column`."""
    return results.groupBy(*index).pivot(column, list(values)).agg(F.first(metric))


def parse_mean_std(results: DataFrame, column: str, mean: str = "mean", std: str = "std") -> DataFrame:
    """Numbers back from `mean ± std` text."""
    parts = F.split(F.trim(column), r"\s+")
    return results.withColumns(
        {mean: F.get(parts, F.lit(0)).try_cast("double"), std: F.get(parts, F.lit(2)).try_cast("double")}
    )


def _label(column: str, labels: dict[str, str]) -> Column:
    out = F.col(column)
    for raw, shown in labels.items():
        out = F.when(F.col(column) == raw, F.lit(shown)).otherwise(out)
    return out


def _rank(column: str, labels: dict[str, str]) -> Column:
    out = F.lit(None).cast("int")
    for position, raw in enumerate(labels):
        out = F.when(F.col(column) == raw, F.lit(position)).otherwise(out)
    return out


def report_rows(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Selected columns under report names, in dataset then model order, with display names."""
    ranked = table.orderBy(
        _rank("dataset", DATASET_LABELS).asc_nulls_last(), _rank("model", MODEL_LABELS).asc_nulls_last()
    )
    shown = ranked.withColumns({"dataset": _label("dataset", DATASET_LABELS), "model": _label("model", MODEL_LABELS)})
    shown = shown.withColumns(
        {
            name: F.replace(name, F.lit("±"), F.lit("+/-"))
            for name, kind in shown.dtypes
            if kind == "string"
        }
    )
    return shown.select(*[F.col(name).alias(title) for name, title in columns.items()])


# Fixed values in this and the following reports: the column titles.
def row_report(table: DataFrame) -> DataFrame:
    return report_rows(
        table,
        {"dataset": "Dataset", "model": "Model", "pr_auc": "PR-AUC", "roc_auc": "ROC-AUC", "f1": "F1", "mcc": "MCC"},
    )


def robustness_report(table: DataFrame) -> DataFrame:
    return report_rows(
        table, {"dataset": "Dataset", "model": "Model", "pr_auc": "PR-AUC", "roc_auc": "ROC-AUC", "f1": "F1"}
    )


def case_report(table: DataFrame) -> DataFrame:
    return report_rows(
        table,
        {"dataset": "Dataset", "model": "Model", "n": "Cases", "f1": "F1", "rec": "Recall", "mcc": "MCC"},
    )


def fixed(value: Column, digits: int, suffix: str = "") -> Column:
    """Text with a fixed number of decimals, ties to even."""
    return F.format_string(f"%.{digits}f{suffix}", F.bround(value, digits))


def percent(value: Column) -> Column:
    return fixed(value * 100.0, 1, "%%")


def type_report(table: DataFrame, profile: str) -> DataFrame:
    """Types of one profile, best detected first, missing last."""

    def ap(name: str) -> Column:
        return F.when(F.col(name).isNull(), "-").otherwise(fixed(F.col(name), 3))

    ordered = table.where(F.col("dataset") == profile).orderBy(F.col("gb_pr_auc").desc_nulls_last(), "tamper_type")
    return ordered.select(
        F.col("tamper_type").alias("Tamper type"),
        F.format_number("n_rows", 0).alias("Records"),
        ap("gb_pr_auc").alias("GB PR-AUC"),
        ap("svm_pr_auc").alias("SVM PR-AUC"),
        percent(F.col("gb_flag_rate")).alias("GB flagged"),
        percent(F.col("svm_flag_rate")).alias("SVM flagged"),
    )


def learning_curve_report(curve: DataFrame, datasets: dict[str, str]) -> DataFrame:
    """Training rows against average precision, one column per dataset."""
    wide = pivot_metric(curve, ["sample_size"], "dataset", list(datasets), "pr_auc").orderBy("sample_size")
    return wide.select(
        F.format_number("sample_size", 0).alias("Training rows"),
        *[F.col(name).alias(title) for name, title in datasets.items()],
    )


def type_matrix(table: DataFrame, datasets: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Manipulated types against (dataset, metric) columns."""
    cells = [
        F.max(F.when(F.col("dataset") == d, F.col(m))).alias(f"{d}_{m}") for d in datasets for m in metrics
    ]
    return table.where(F.col("tamper_type") != NORMAL).groupBy("tamper_type").agg(*cells)


def stationary_rates(scored: DataFrame, by: Sequence[str] = ("detector", "flight")) -> DataFrame:
    """Flag rates overall, while stationary and while moving; NULL where there are no such rows.

    A row with missing speed counts as moving.
    """
    hit = F.col("flagged").cast("double")
    still = holds(F.abs(F.col("speed")) <= STATIONARY_MPS)
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("flagged").alias("flagged"),
        F.avg(hit).alias("flag_rate"),
        F.count_if(still).alias("stationary_rows"),
        F.avg(F.when(still, hit)).alias("stationary_flag_rate"),
        F.avg(F.when(~still, hit)).alias("moving_flag_rate"),
    )


def flight_flag_rates(scored: DataFrame, flight: str = "source") -> DataFrame:
    """Rows, flagged rows and flagged percentage of every flight."""
    counted = scored.groupBy(flight).agg(F.count(F.lit(1)).alias("rows"), F.count_if("flagged").alias("flagged"))
    return counted.withColumn("pct", F.bround(F.col("flagged") / F.col("rows") * 100.0, 1))


def top_suspicious(scored: DataFrame, rows: int = 10, ties: Sequence[str] = ("source", "row_idx")) -> DataFrame:
    """The highest scores; ties by flight and row."""
    return scored.orderBy(F.col("anomaly_score").desc(), *ties).limit(rows)


def detector_ranges(summary: DataFrame) -> DataFrame:
    """Lowest and highest rate over flights, per detector."""
    table = summary.groupBy("detector").agg(
        *[
            part
            for name in ("flag_rate", "stationary_flag_rate")
            for part in (F.min(name).alias(f"{name}_lo"), F.max(name).alias(f"{name}_hi"))
        ]
    )

    def span(name: str) -> Column:
        return F.concat(percent(F.col(f"{name}_lo")), F.lit(" - "), percent(F.col(f"{name}_hi")))

    return table.withColumns({"flagged": span("flag_rate"), "stationary": span("stationary_flag_rate")})


def mission_titles(logs: DataFrame, source: str = "source", order: str = "row_idx") -> DataFrame:
    """Title of every log: the first non-missing value of the first usable title column, else the log's name.

    A value is usable if it is not blank and every character is Latin-1.
    """
    present = [c for c in TITLE_CANDIDATES if c in logs.columns]
    firsts = logs.groupBy(source).agg(
        F.lit(None).cast("string").alias("_none"),
        *[F.trim(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))).alias(c) for c in present],
    )
    usable = [F.when(F.col(c).rlike(r"^[\x{01}-\x{FF}]+$"), F.col(c)) for c in present]
    return firsts.select(source, F.coalesce(*usable, F.col(source)).alias("title"))


def ground_track(scored: DataFrame, titles: DataFrame, source: str = "source") -> DataFrame:
    """Position, flag and title of every row. `titles` has one row per log."""
    slim = scored.select(source, "row_idx", "longitude", "latitude", "flagged")
    return slim.join(titles, source, "left")
