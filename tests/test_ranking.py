"""Ranking metrics: brute force, both window plans, ties and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from flightseal.operators import casewise, ranking
from flightseal.operators import running
from flightseal.operators.running import running_sums
from tests import brute


@pytest.fixture(scope="module")
def scored(spark):
    random.seed(7)
    rows = []
    for group, (n, values) in {"ties": (400, 12), "fine": (600, 10_000), "tiny": (5, 3)}.items():
        for i in range(n):
            label = int(random.random() < 0.3) if group != "tiny" else i % 2
            score = (random.randrange(values) + label * values // 5) / values
            rows.append((group, label, score))
    return rows, spark.createDataFrame(rows, "g string, label int, score double").repartition(6)


@pytest.mark.parametrize("depth", [None, 0, 2, 5])
def test_metrics_against_brute_force(scored, depth):
    rows, df = scored
    ranked = ranking.ranked_scores(df, ["g"], depth=depth)
    quality = {r["g"]: r for r in ranking.ranking_quality(ranked, ["g"]).collect()}
    best = {r["g"]: r["threshold"] for r in ranking.best_thresholds(ranked, ["g"]).collect()}
    for group in ("ties", "fine", "tiny"):
        labels = [y for g, y, _ in rows if g == group]
        scores = [s for g, _, s in rows if g == group]
        assert quality[group]["n"] == len(labels) and quality[group]["pos"] == sum(labels)
        assert quality[group]["pr_auc"] == pytest.approx(brute.average_precision(labels, scores), abs=1e-12)
        assert quality[group]["roc_auc"] == pytest.approx(brute.roc_auc(labels, scores), abs=1e-12)
        assert best[group] == brute.best_threshold(labels, scores)


def test_range_plan_gives_the_same_rows(spark):
    random.seed(1)
    rows = [(g, float(v) if v else None, random.randrange(5)) for g in ("a", "b") for v in range(300)]
    counts = spark.createDataFrame(rows, "g string, v double, n long")
    for descending in (True, False):
        plain = running_sums(counts, ["g"], "v", ["n"], descending, depth=0)
        ranged = running_sums(counts, ["g"], "v", ["n"], descending, depth=4)
        names = ["g", "v", "n", "cum_n", "total_n"]
        assert sorted(map(repr, plain.select(names).collect())) == sorted(map(repr, ranged.select(names).collect()))
    alone = running_sums(counts.drop("g").groupBy("v").agg(F.sum("n").alias("n")), [], "v", ["n"], depth=3)
    assert alone.agg(F.max("cum_n"), F.max("total_n")).first()[0] == sum(r[2] for r in rows)


def test_plan_follows_the_number_of_distinct_values(spark):
    counts = spark.range(100).selectExpr("1 as g", "cast(id as double) as v", "1L as n")
    spark.conf.set("spark.flightseal.windowRows", "50")
    try:
        ranged = running_sums(counts, ["g"], "v", ["n"])
    finally:
        spark.conf.unset("spark.flightseal.windowRows")
    assert "_range" in ranged._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" not in running_sums(counts, ["g"], "v", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    assert [r["cum_n"] for r in ranged.orderBy("v").collect()] == list(range(100, 0, -1))


def test_order_preserving_maps_change_nothing(scored):
    _, df = scored
    moved = df.withColumn("score", F.exp("score") * 7 - 100)
    a, b = [
        ranking.ranking_quality(ranking.ranked_scores(d, ["g"]), ["g"]).orderBy("g").collect() for d in (df, moved)
    ]
    for x, y in zip(a, b):
        assert x["pr_auc"] == pytest.approx(y["pr_auc"]) and x["roc_auc"] == pytest.approx(y["roc_auc"])


def test_known_threshold_metrics(spark):
    rows = [(1, 0.9), (1, 0.8), (1, 0.2), (0, 0.85), (0, 0.1), (0, 0.1), (0, 0.1)]
    df = spark.createDataFrame(rows, "label int, score double")
    m = ranking.threshold_metrics(df, [], F.lit(0.8)).first()
    assert (m["tp"], m["fp"], m["n"], m["pos"]) == (2, 1, 7, 3)
    assert m["f1"] == pytest.approx(2 / 3) and m["prec"] == pytest.approx(2 / 3) and m["rec"] == pytest.approx(2 / 3)
    assert m["bal_acc"] == pytest.approx((2 / 3 + 3 / 4) / 2)
    assert m["mcc"] == pytest.approx((2 * 3 - 1 * 1) / (3 * 3 * 4 * 4) ** 0.5)
    assert ranking.threshold_metrics(df, [], F.lit(2.0)).first()["f1"] == 0.0
    assert ranking.threshold_metrics(df, [], F.lit(2.0)).first()["mcc"] == 0.0


def test_single_class(spark):
    df = spark.createDataFrame([("n", 0, 0.2), ("n", 0, 0.4), ("p", 1, 0.2)], "g string, label int, score double")
    ranked = ranking.ranked_scores(df, ["g"])
    quality = {r["g"]: r for r in ranking.ranking_quality(ranked, ["g"]).collect()}
    assert quality["n"]["roc_auc"] is None and quality["p"]["roc_auc"] is None
    assert quality["n"]["pr_auc"] == 0.0 and quality["p"]["pr_auc"] == 1.0
    best = {r["g"]: r["threshold"] for r in ranking.best_thresholds(ranked, ["g"]).collect()}
    assert best == {"n": 0.2, "p": 0.2}


def test_metrics_table_joins_threshold_per_model(scored, spark):
    _, df = scored
    thresholds = spark.createDataFrame([("ties", 0.5), ("fine", 0.7), ("tiny", 0.0)], "g string, threshold double")
    table = ranking.metrics_table(ranking.ranked_scores(df, ["g"]), ["g"], thresholds, ["g"])
    direct = ranking.threshold_metrics(df.join(thresholds, "g"), ["g"], F.col("threshold"))
    for a, b in zip(table.orderBy("g").collect(), direct.orderBy("g").collect()):
        for name in ("n", "pos", "f1", "prec", "rec", "bal_acc", "mcc"):
            assert a[name] == pytest.approx(b[name])


def test_types_against_normal_rows(spark):
    random.seed(9)
    kinds = ["normal"] * 6 + ["injection", "altitude_spike", "deletion_gap"]
    rows = [(random.choice(kinds), random.randrange(20) / 20) for _ in range(500)]
    df = spark.createDataFrame([("d", "m", t, s) for t, s in rows], "dataset string, model string, tamper_type string, score double")
    thresholds = spark.createDataFrame([("m", 0.6)], "model string, threshold double")
    for depth in (0, 3):
        got = {
            r["tamper_type"]: r
            for r in casewise.per_type_rows(df, ["dataset", "model"], thresholds, ["model"], depth=depth).collect()
        }
        assert set(got) == set(casewise.ALL_TYPES)
        for kind in ("injection", "altitude_spike", "deletion_gap"):
            pairs = [(int(t == kind), s) for t, s in rows if t in (kind, "normal")]
            labels, scores = [p[0] for p in pairs], [p[1] for p in pairs]
            tp = sum(1 for y, s in pairs if y and s >= 0.6)
            fp = sum(1 for y, s in pairs if not y and s >= 0.6)
            precision, recall = tp / max(tp + fp, 1), tp / sum(labels)
            assert got[kind]["n_rows"] == sum(labels)
            assert got[kind]["flag_rate"] == pytest.approx(recall)
            assert got[kind]["pr_auc"] == pytest.approx(brute.average_precision(labels, scores))
            assert got[kind]["f1"] == pytest.approx(2 * precision * recall / (precision + recall))
        normal = [s for t, s in rows if t == "normal"]
        assert got["normal"]["flag_rate"] == pytest.approx(sum(s >= 0.6 for s in normal) / len(normal))
        assert got["normal"]["pr_auc"] is None and got["normal"]["f1"] is None
        absent = got["speed_inconsistency"]
        assert (absent["n_rows"], absent["flag_rate"], absent["pr_auc"], absent["f1"]) == (0, 0.0, 0.0, 0.0)


def test_no_normal_rows(spark):
    df = spark.createDataFrame([("m", "injection", 0.7)], "model string, tamper_type string, score double")
    thresholds = spark.createDataFrame([("m", 0.6)], "model string, threshold double")
    got = {r["tamper_type"]: r for r in casewise.per_type_rows(df, ["model"], thresholds, ["model"]).collect()}
    assert got["normal"]["flag_rate"] is None and got["injection"]["flag_rate"] == 1.0


def test_flights_by_type(spark):
    rows = [(0, "case_0000_altitude_spike", 0.9), (0, "case_0000_altitude_spike", 0.1), (1, "case_0001_normal", 0.7),
            (2, "case_0002_altitude_spike", 0.2)]
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, case_id int, case_name string, score double")
    cases = casewise.case_types(df, ["model", "case_id"])
    assert {(r["case_id"], r["type"], r["score"]) for r in cases.collect()} == {
        (0, "altitude_spike", 0.9), (1, "normal", 0.7), (2, "altitude_spike", 0.2)
    }
    thresholds = spark.createDataFrame([("m", 0.6)], "model string, threshold double")
    table = {r["tamper_type"]: r for r in casewise.per_type_cases(cases, ["model"], thresholds, ["model"]).collect()}
    assert len(table) == 10
    assert (table["altitude_spike"]["n_cases"], table["altitude_spike"]["flag_rate"]) == (2, 0.5)
    assert (table["injection"]["n_cases"], table["injection"]["flag_rate"]) == (0, None)


@pytest.mark.parametrize("descending", [True, False])
def test_ranges_of_ranges(spark, descending, monkeypatch):
    """Distinct values only, so many that their ranges need ranges: three levels of at most four rows a window."""
    rows = [(g, v) for g in ("a", "b") for v in range(70)]
    counts = spark.createDataFrame([(g, float(v), v % 5, 1) for g, v in rows], "g string, v double, n long, m long")
    seen = []
    sorted_places = running.sorted_places

    def watched(df, keys, order, name, many):
        out = sorted_places(df, keys, order, name, many)
        seen.append(many)
        return out

    monkeypatch.setattr(running, "sorted_places", watched)
    spark.conf.set("spark.flightseal.windowRows", "4")
    try:
        got = running_sums(counts, ["g"], "v", ["n", "m"], descending)
    finally:
        spark.conf.unset("spark.flightseal.windowRows")
    assert len(seen) == 3 and seen[0] == 140 and seen[1] == 36 and seen[2] == 10
    plain = running_sums(counts, ["g"], "v", ["n", "m"], descending, depth=0)
    names = ["g", "v", "n", "cum_n", "total_n", "cum_m", "total_m"]
    assert sorted(map(repr, plain.select(names).collect())) == sorted(map(repr, got.select(names).collect()))
