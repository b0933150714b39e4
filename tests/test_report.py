"""Audit and report tables."""

import pytest
from pyspark.sql import functions as F

from flightseal.operators import audit, report
from flightseal.sources import results
from tests.test_features import row, table

# Published metrics of four replicates (replicate, dataset, model, pr_auc, roc_auc, f1).
REPLICATES = [
    (0, "strong", "GradientBoosting", 0.7707, 0.8325, 0.6935),
    (1, "strong", "GradientBoosting", 0.7639, 0.8396, 0.6944),
    (2, "strong", "GradientBoosting", 0.7734, 0.8398, 0.7034),
    (3, "strong", "GradientBoosting", 0.7572, 0.8127, 0.6846),
    (0, "subtle", "LinearSVC", 0.5348, 0.6397, 0.3632),
    (1, "subtle", "LinearSVC", 0.5552, 0.6781, 0.4442),
    (2, "subtle", "LinearSVC", 0.5178, 0.6399, 0.4453),
    (3, "subtle", "LinearSVC", 0.6145, 0.683, 0.4775),
]
PUBLISHED = {
    ("strong", "GradientBoosting"): {"pr_auc": (0.7663, 0.0063), "roc_auc": (0.8311, 0.0111), "f1": (0.6940, 0.0067)},
    ("subtle", "LinearSVC"): {"pr_auc": (0.5556, 0.0365), "roc_auc": (0.6602, 0.0204), "f1": (0.4325, 0.0422)},
}
# Formatting ties make the published text differ by one unit in the last place.
TIE = 1.1e-4


@pytest.fixture(scope="module")
def robustness(spark):
    return spark.createDataFrame(REPLICATES, "replicate int, dataset string, model string, pr_auc double, roc_auc double, f1 double")


def test_mean_and_std_match_the_published_summary(robustness):
    summary = report.summarise(robustness, ["dataset", "model"], ["pr_auc", "roc_auc", "f1"])
    for r in summary.collect():
        for metric, (mean, std) in PUBLISHED[(r["dataset"], r["model"])].items():
            assert r[f"{metric}_mean"] == pytest.approx(mean, abs=TIE)
            assert r[f"{metric}_std"] == pytest.approx(std, abs=TIE)
            assert r[metric].split(" ± ")[1] == f"{std:.4f}"
    parsed = report.parse_mean_std(summary, "pr_auc", "m", "s").where("dataset = 'subtle'").first()
    assert parsed["m"] == pytest.approx(0.5556, abs=TIE) and parsed["s"] == 0.0365


def test_stacked_tables_keep_missing_columns(robustness, spark):
    rbf = spark.createDataFrame(
        [(0, "strong", "RBF-SVC", 20000, 25.3, 0.7329, 0.6686, 0.5915), (1, "strong", "RBF-SVC", 20000, 29.0, 0.7383, 0.6722, 0.5957)],
        "replicate int, dataset string, model string, train_rows int, fit_s double, roc_auc double, pr_auc double, f1 double",
    )
    both = report.stack_results(robustness, rbf)
    assert both.columns == [*robustness.columns, "train_rows", "fit_s"]
    summary = report.summarise(both, ["dataset", "model"], ["pr_auc"], ["fit_s"])
    fit = {r["model"]: r["fit_s"] for r in summary.collect()}
    assert fit == {"GradientBoosting": None, "LinearSVC": None, "RBF-SVC": pytest.approx(27.15)}
    wide = report.pivot_metric(both.where("dataset = 'strong'"), ["replicate"], "model", ["GradientBoosting", "RBF-SVC"], "pr_auc")
    assert {tuple(r) for r in wide.collect()} == {(0, 0.7707, 0.6686), (1, 0.7639, 0.6722), (2, 0.7734, None), (3, 0.7572, None)}


def test_report_order_and_names(spark):
    rows = [("subtle", "LinearSVC"), ("strong", "RBF-SVC"), ("balanced_holdout", "LinearSVC"), ("strong", "GradientBoosting"), ("other", "mine")]
    df = spark.createDataFrame([(d, m, "0.5 ± 0.1", 0.5, 0.5) for d, m in rows], "dataset string, model string, pr_auc string, roc_auc double, f1 double")
    got = [tuple(r)[:3] for r in report.robustness_report(df).collect()]
    assert got == [
        ("Balanced holdout", "Linear SVM", "0.5 +/- 0.1"),
        ("Strong", "Gradient Boosting", "0.5 +/- 0.1"),
        ("Strong", "RBF SVM", "0.5 +/- 0.1"),
        ("Subtle", "Linear SVM", "0.5 +/- 0.1"),
        ("other", "mine", "0.5 +/- 0.1"),
    ]
    cases = df.withColumns({"n": F.lit(12), "rec": F.lit(1.0), "mcc": F.lit(1.0)})
    assert report.case_report(cases).columns == ["Dataset", "Model", "Cases", "F1", "Recall", "MCC"]
    assert report.row_report(cases).columns == ["Dataset", "Model", "PR-AUC", "ROC-AUC", "F1", "MCC"]


def test_type_report(spark):
    rows = [("subtle", "normal", 494624, None, None, 0.0418, 0.0426), ("subtle", "deletion_gap", 8000, 0.0221, 0.01, 0.025, 0.1),
            ("subtle", "altitude_spike", 21352, 0.7142, 0.3683, 0.6843, 0.5654), ("strong", "normal", 1, None, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "dataset string, tamper_type string, n_rows long, gb_pr_auc double, svm_pr_auc double, gb_flag_rate double, svm_flag_rate double")
    assert [tuple(r) for r in report.type_report(df, "subtle").collect()] == [
        ("altitude_spike", "21,352", "0.714", "0.368", "68.4%", "56.5%"),
        ("deletion_gap", "8,000", "0.022", "0.010", "2.5%", "10.0%"),
        ("normal", "494,624", "-", "-", "4.2%", "4.3%"),
    ]
    matrix = report.type_matrix(df, ["strong", "subtle"], ["gb_pr_auc"])
    assert {tuple(r) for r in matrix.collect()} == {("deletion_gap", None, 0.0221), ("altitude_spike", None, 0.7142)}


def test_learning_curve_report(spark):
    rows = [(10000, "balanced_holdout", 0.613), (5000, "balanced_holdout", 0.5917), (5000, "subtle_120k", 0.7101), (10000, "subtle_120k", 0.6475)]
    df = spark.createDataFrame(rows, "sample_size int, dataset string, pr_auc double")
    got = report.learning_curve_report(df, {"balanced_holdout": "Holdout", "subtle_120k": "Subtle"})
    assert [tuple(r) for r in got.collect()] == [("5,000", 0.5917, 0.7101), ("10,000", 0.613, 0.6475)]


def test_detector_ranges_match_the_published_table(spark):
    rows = [("Pooled", "a", 0.4754, 0.4923), ("Pooled", "b", 0.3775, 0.2616), ("Pooled", "c", 0.4659, 0.2319),
            ("Main", "a", 0.9978, 1.0), ("Main", "b", 0.9951, 0.9942), ("Main", "c", 0.9802, 0.9855)]
    df = spark.createDataFrame(rows, "detector string, flight string, flag_rate double, stationary_flag_rate double")
    got = {r["detector"]: (r["flagged"], r["stationary"]) for r in report.detector_ranges(df).collect()}
    assert got == {"Pooled": ("37.8% - 47.5%", "23.2% - 49.2%"), "Main": ("98.0% - 99.8%", "98.6% - 100.0%")}


def test_stationary_rates(spark):
    rows = [("d", "a", 0.5, True), ("d", "a", -0.4, False), ("d", "a", 0.51, True), ("d", "a", None, False), ("d", "b", 3.0, True)]
    df = spark.createDataFrame(rows, "detector string, flight string, speed double, flagged boolean")
    got = {r["flight"]: r for r in report.stationary_rates(df).collect()}
    assert (got["a"]["rows"], got["a"]["flagged"], got["a"]["stationary_rows"]) == (4, 2, 2)
    assert (got["a"]["flag_rate"], got["a"]["stationary_flag_rate"], got["a"]["moving_flag_rate"]) == (0.5, 0.5, 0.5)
    assert (got["b"]["stationary_rows"], got["b"]["stationary_flag_rate"], got["b"]["moving_flag_rate"]) == (0, None, 1.0)


def test_flag_rates_and_top_rows(spark):
    rows = [("a", i, float(i % 5), i % 8 == 0) for i in range(16)] + [("b", 0, 4.0, False)]
    df = spark.createDataFrame(rows, "source string, row_idx int, anomaly_score double, flagged boolean")
    got = {r["source"]: tuple(r) for r in report.flight_flag_rates(df).collect()}
    assert got == {"a": ("a", 16, 2, 12.5), "b": ("b", 1, 0, 0.0)}
    top = report.top_suspicious(df, 4).collect()
    assert [(r["source"], r["row_idx"]) for r in top] == [("a", 4), ("a", 9), ("a", 14), ("b", 0)]


def test_titles(spark):
    rows = [("a", 0, None, "x"), ("a", 2, " late ", "y"), ("a", 1, " Früh ", "z"), ("b", 0, "정찰", None), ("b", 1, "ok", "log"),
            ("c", 0, None, None), ("d", 0, "  ", " d ")]
    df = spark.createDataFrame(rows, "source string, row_idx int, MissionName string, FlightLogName string")
    assert {tuple(r) for r in report.mission_titles(df).collect()} == {("a", "Früh"), ("b", "log"), ("c", "c"), ("d", "d")}
    assert {tuple(r) for r in report.mission_titles(df.drop("MissionName", "FlightLogName")).collect()} == {
        (s, s) for s in "abcd"
    }


def test_audit_record(spark):
    rows = [row(0, 0, 0.0), row(0, 1, 100.0), row(0, 2, 99.0), row(1, 0, 0.0), row(1, 1, 2.0, speed=None), row(1, 2, None)]
    labels = {(0, 1): (1, "injection"), (0, 2): (1, "injection")}
    kinds = [(r["case_id"], r["row_idx"], *labels.get((r["case_id"], r["row_idx"]), (0, "normal"))) for r in rows]
    df = table(spark, rows).join(
        spark.createDataFrame(kinds, "case_id int, row_idx int, label int, tamper_type string"), ["case_id", "row_idx"]
    ).withColumn("profile", F.lit("p"))
    df = df.unionByName(df.where("case_id = 1 and row_idx = 1")).unionByName(
        df.where("case_id = 0 and row_idx = 2").withColumn("row_idx", F.lit(3))
    )
    record = audit.audit(df)
    r = record.first()
    assert (r["rows"], r["cases"], r["epoch_rows"]) == (8, 2, 7)
    assert r["anomaly_rate"] == 0.375
    assert r["label_counts"] == {"0": 5, "1": 3} and r["case_label_counts"] == {"0": 1, "1": 1}
    assert r["tamper_type_cases"] == {"injection": 1, "normal": 2}
    assert r["missing"] == {"speed": 2, "timestamp": 1}
    assert (r["exact_duplicate_rows"], r["duplicate_rows_ignoring_idx"]) == (1, 3)
    assert (r["ts_decrease_frac"], r["ts_max_gap_s"], r["ts_gaps_gt_60s"]) == (0.125, 100.0, 1)
    path = spark.conf.get("spark.checkpoint.dir") + "/audit.json"
    results.write_audit(record, path)
    assert spark.read.json(path).first()["label_counts"]["1"] == 3


def test_clean_table_has_no_missing_entries(spark):
    df = table(spark, [row(0, i, float(i)) for i in range(3)]).withColumns({"profile": F.lit("p"), "label": F.lit(0), "tamper_type": F.lit("normal")})
    assert audit.missing(df, ["profile"]).count() == 0
    assert not audit.audit(df).first()["missing"]
    assert audit.duplicates(df).first().asDict() == {"exact_duplicate_rows": 0, "duplicate_rows_ignoring_idx": 0}
    again = df.unionByName(df.withColumn("row_idx", F.col("row_idx") + 9))
    assert audit.duplicates(again).first().asDict() == {"exact_duplicate_rows": 0, "duplicate_rows_ignoring_idx": 3}


def test_only_possible_twins_are_moved(spark):
    """Rows without a twin are filtered where they lie; what is left is compared in all columns."""
    path = spark.conf.get("spark.checkpoint.dir") + "/twins.parquet"
    rows = [(i % 3, i, i // 3, f"text {i}" if i % 50 else "same", None if i % 7 else 1.5) for i in range(3000)]
    rows += rows[:40] + [(0, 9000, 1, None, None)] * 3 + [(None, 1, 1, "x", 1.0)] * 2
    spark.createDataFrame(rows, "part int, case_id int, row_idx int, text string, value double").write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    left = audit.possible_twins(df, ["part"], ["text", "value"])
    alike = {}
    for r in rows:
        alike.setdefault((r[0], r[3], r[4]), []).append(r)
    twins = [r for group in alike.values() if len(group) > 1 for r in group]
    assert len(twins) <= left.count() < len(twins) + 300
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    for groups in (["part"], []):
        got = {r[0] if groups else None: tuple(r)[-2:] for r in audit.duplicates(df, groups).collect()}
        wanted = {}
        for r in rows:
            wanted.setdefault(r[0] if groups else None, []).append(r)
        for key, own in wanted.items():
            content = {(r[3], r[4]) if groups else (r[0], r[3], r[4]) for r in own}
            assert got[key] == (len(own) - len(set(own)), len(own) - len(content))
    unique = df.where("case_id between 1 and 40").dropDuplicates()
    assert [tuple(r) for r in audit.duplicates(unique, []).collect()] == [(0, 0)]


def test_unclear_order_is_counted(spark):
    rows = [("a", 1, 0), ("a", 1, 0), ("a", 1, 1), ("a", 2, None), ("a", 2, None), ("a", 3, 5), ("b", 1, 0), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "profile string, case_id int, row_idx int")
    got = {r["profile"]: tuple(r)[1:] for r in audit.repeated_places(df, ["profile"]).collect()}
    assert got == {"a": (1, 2, 2), "b": (0, 0, 0)}
    assert tuple(audit.repeated_places(df).first()) == (3, 2, 2)  # without the profile flights share a number: 0 three times, 1 twice


def test_flight_sketches_merge(spark):
    """Parts may hold the same flight numbers; their sketches add up within the stated error."""
    df = spark.range(60_000).selectExpr("cast(id % 2 as string) as profile", "cast(id % 3 as int) as replicate", "cast(id div 6 as int) as case_id")
    parts = audit.case_sketches(df)
    assert parts.count() == 6
    for groups, flights in ((["profile"], 30_000), ([], 60_000), (["profile", "replicate"], 10_000)):
        for r in audit.approximate_cases(parts, groups).collect():
            assert abs(r["cases"] / flights - 1) < 4 * 1.04 / 2 ** (audit.SKETCH_BITS / 2)
            assert r["rows"] == flights
