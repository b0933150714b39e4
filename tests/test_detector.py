"""Exact quantiles and the label-free detector."""

import random

import pytest
from pyspark.sql import functions as F

from flightseal.constants import CONSISTENCY_FEATURES
from flightseal.operators import detector
from flightseal.operators.quantiles import percentiles, robust_stats
from tests.brute import centre_scale, quantile

SMALL = dict(group_rows=1, total_rows=1)


@pytest.fixture(scope="module")
def values(spark):
    """A group above the keep-all bound, a heavy tie, a single row, an empty one."""
    random.seed(2)
    data = {
        "big": [random.gauss(0, 3) for _ in range(25_000)],
        "ties": [0.0] * 700 + [random.random() for _ in range(301)],
        "one": [4.5],
        "none": [None, None],
        "pair": [1.0, 2.0],
    }
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("big", None)] * 50
    return data, spark.createDataFrame(rows, "g string, x double").repartition(4)


@pytest.mark.parametrize("limits", [{}, SMALL, dict(group_rows=500, total_rows=1)])
def test_percentiles(values, limits):
    data, df = values
    wanted = {f"p{int(p * 1000)}": (F.col("x"), p) for p in (0.0, 0.25, 0.5, 0.995, 1.0)}
    got = {r["g"]: r for r in percentiles(df, ["g"], wanted, [F.count("x").alias("n")], **limits).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        for name, (_, p) in wanted.items():
            expected = quantile(vs, p)
            assert got[g][name] == (None if expected is None else pytest.approx(expected, abs=1e-12)), (g, name)
        assert got[g]["n"] == sum(v is not None for v in vs)


@pytest.mark.parametrize("limits", [{}, dict(total_rows=1)])
def test_ungrouped_percentile(values, limits):
    data, df = values
    got = percentiles(df, [], {"m": (F.abs("x"), 0.9)}, **limits).first()["m"]
    assert got == pytest.approx(quantile([abs(v) for vs in data.values() for v in vs if v is not None], 0.9))


def test_many_distinct_values_use_ranges(values, spark):
    data, df = values
    spark.conf.set("spark.flightseal.windowRows", "20")
    try:
        got = percentiles(df, ["g"], {"m": (F.col("x"), 0.5)}, **SMALL).collect()
    finally:
        spark.conf.unset("spark.flightseal.windowRows")
    for r in got:
        expected = quantile(data[r["g"]], 0.5)
        assert r["m"] == (None if expected is None else pytest.approx(expected))


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_centre_and_scale(spark, limits):
    groups = {
        "spread": [float(i * i) for i in range(9)],
        "mad_zero": [5.0] * 8 + [6.0, 9.0],
        "constant": [3.0] * 6,
        "empty": [None] * 3,
        "single": [2.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, x double")
    got = {r["g"]: (r["x_median"], r["x_scale"]) for r in robust_stats(df, ["g"], ["x"], **limits).collect()}
    for g, vs in groups.items():
        for mine, expected in zip(got[g], centre_scale(vs)):
            assert mine == (None if expected is None else pytest.approx(expected)), g


def frame(spark, rows):
    names = [*CONSISTENCY_FEATURES, "alt_rate_mps"]
    schema = "source string, row_idx int, phase string, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame([(r["source"], r["row_idx"], r["phase"], *[r[n] for n in names]) for r in rows], schema)


def expected_scores(rows, pool_of, threshold=4.0):
    out = {}
    for pool in {pool_of(r) for r in rows}:
        members = [r for r in rows if pool_of(r) == pool]
        top = quantile([abs(r["alt_rate_mps"]) for r in members if r["alt_rate_mps"] is not None], 0.995)
        bound = max(3.0, 2.0 * top) if top is not None else 3.0
        z = {id(r): {} for r in members}
        for c in CONSISTENCY_FEATURES:
            for phase in {r["phase"] for r in members} - {None}:
                group = [r for r in members if r["phase"] == phase]
                median, scale = centre_scale([r[c] for r in (group if len(group) >= 20 else members)])
                for r in group:
                    missing = scale is None or r[c] is None
                    z[id(r)][c] = 0.0 if missing else abs((r[c] - median) / scale)
        for r in members:
            sizes = [z[id(r)].get(c, 0.0) for c in CONSISTENCY_FEATURES]
            sizes.append(0.0 if r["alt_rate_mps"] is None else threshold * abs(r["alt_rate_mps"]) / bound)
            score = max(sizes)
            worst = [*CONSISTENCY_FEATURES, "alt_rate_mps"][sizes.index(score)]
            out[(r["source"], r["row_idx"])] = (score, worst, score > threshold)
    return out


@pytest.fixture(scope="module")
def logs():
    """Phases of 19 and 20 rows, missing phases, a constant feature, missing values."""
    random.seed(4)
    rows = []
    for source, phases in {"a": ["up"] * 19 + ["go"] * 60 + [None] * 4, "b": ["up"] * 20 + ["go"] * 30, "c": [None] * 5}.items():
        for i, phase in enumerate(phases):
            r = dict(source=source, row_idx=i, phase=phase)
            for c in CONSISTENCY_FEATURES:
                r[c] = None if random.random() < 0.05 else float(random.choice([0, 0, 0, 1, 2, 64]) + (i % 7) / 8)
            r["dt_s"] = 0.125
            r["alt_rate_mps"] = None if i == 0 else random.choice([0.0, 0.5, 2.0, 16.0])
            rows.append(r)
    return rows


@pytest.mark.parametrize("limits", [{}, SMALL])
@pytest.mark.parametrize("pool", [[], ["source"]])
def test_scores(spark, logs, pool, limits):
    got = detector.score_baseline(frame(spark, logs).repartition(3), pool, **limits)
    mine = {(r["source"], r["row_idx"]): r for r in got.collect()}
    expected = expected_scores(logs, lambda r: r["source"] if pool else 0)
    assert set(mine) == set(expected)
    for key, (score, worst, flagged) in expected.items():
        assert mine[key]["anomaly_score"] == pytest.approx(score), key
        assert (mine[key]["worst_feature"], mine[key]["flagged"]) == (worst, flagged), key
    assert "_pool" not in got.columns


def test_all_zero_row_reports_the_first_feature(spark):
    rows = [dict(source="a", row_idx=i, phase="p", alt_rate_mps=0.0, **{c: 1.0 for c in CONSISTENCY_FEATURES}) for i in range(25)]
    got = detector.score_baseline(frame(spark, rows)).collect()
    assert {(r["anomaly_score"], r["worst_feature"], r["flagged"]) for r in got} == {(0.0, "dt_s", False)}


def test_score_at_the_threshold_is_not_flagged(spark):
    zero = {c: 1.0 for c in CONSISTENCY_FEATURES}
    rows = [dict(source="a", row_idx=i, phase="p", alt_rate_mps=0.0, **zero) for i in range(1000)]
    rows[5]["alt_rate_mps"] = 3.0
    rows[6]["alt_rate_mps"] = 3.5
    got = {r["row_idx"]: r for r in detector.score_baseline(frame(spark, rows)).collect()}
    assert got[5]["anomaly_score"] == 4.0 and not got[5]["flagged"]
    assert got[6]["flagged"] and got[6]["worst_feature"] == "alt_rate_mps"


def test_missed_bounds_are_tried_again(values, monkeypatch):
    """Bounds of hardly any accuracy and no margin to speak of miss; the quantiles are exact all the same."""
    from flightseal.operators import quantiles

    data, df = values
    tries, bounds = [], quantiles._bounds
    monkeypatch.setattr(quantiles, "_ACCURACY", 8)
    monkeypatch.setattr(quantiles, "_MARGIN", 1e-3)
    monkeypatch.setattr(quantiles, "_KEEP_ALL", 0)
    monkeypatch.setattr(quantiles, "_bounds", lambda rows, group, shares, also, margin: (tries.append((sorted(shares), margin)), bounds(rows, group, shares, also, margin))[1])
    wanted = {f"p{int(p * 1000)}": (F.col("x"), p) for p in (0.25, 0.5, 0.995)}
    got = {r["g"]: r for r in percentiles(df, ["g"], wanted, [F.count("x").alias("n")], **SMALL).collect()}
    for g, vs in data.items():
        for name, (_, p) in wanted.items():
            expected = quantile(vs, p)
            assert got[g][name] == (None if expected is None else pytest.approx(expected, abs=1e-12)), (g, name)
        assert got[g]["n"] == sum(v is not None for v in vs)
    assert len(tries) > 1 and [m for _, m in tries] == [1e-3 * 2**i for i in range(len(tries))]


def test_merged_sketches(spark):
    """Three parts merged state what one sketch of all rows does, both within the error of the exact quantiles."""
    from flightseal.operators import sketches

    random.seed(6)
    rows = [(f"p{i % 2}", i % 3, random.gauss(i % 2, 2), None) for i in range(12_000)] + [("p2", 0, 1.5, 2.0), (None, 1, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "phase string, part int, x double, y double").repartition(5)
    k, keys, columns = 400, ["phase"], ["x", "y"]
    one = sketches.sketch_table(df, keys, columns, k)
    many = sketches.merged([sketches.sketch_table(df.where(F.col("part") == p), keys, columns, k) for p in range(3)], keys, columns)
    tables = [{r["phase"]: r for r in sketches.robust(t, keys, columns).collect()} for t in (one, many)]
    for phase in ("p0", "p1"):
        values = sorted(r[2] for r in rows if r[0] == phase)
        centre, scale = centre_scale(values)
        for table in tables:
            r = table[phase]
            assert r["rows"] == 6000 and r["y_median"] is None and r["y_scale"] is None
            e = sketches.rank_error(k)
            assert quantile(values, 0.5 - e) <= r["x_median"] <= quantile(values, 0.5 + e)
            away = [abs(v - r["x_median"]) * 1.4826 for v in values]
            e = sketches.scale_error(k)
            assert quantile(away, 0.5 - e) <= r["x_scale"] <= quantile(away, 0.5 + e)
            assert r["x_scale"] == pytest.approx(scale, rel=0.05)
    assert tables[1]["p2"]["x_median"] == 1.5 and tables[1]["p2"]["x_scale"] is None
    moments = {r["phase"]: r for r in many.collect()}
    values = [r[2] for r in rows if r[0] == "p0"]
    mean = sum(values) / len(values)
    assert moments["p0"]["x_mean"] == pytest.approx(mean) and moments["p0"]["x_m2"] == pytest.approx(sum((v - mean) ** 2 for v in values))


def test_scores_from_sketches(spark):
    """Rows judged by sketches, their own or those of earlier logs, score about as exactly judged ones."""
    random.seed(9)
    columns = [*CONSISTENCY_FEATURES, detector.ALTITUDE_RATE]
    rows = [(f"s{i % 3}", i, "A" if i % 4 else "B", *[random.gauss(0, 1) + (25 if i == 77 else 0) for _ in columns]) for i in range(3000)]
    df = spark.createDataFrame(rows, "source string, row_idx int, phase string, " + ", ".join(f"{c} double" for c in columns))
    score = lambda **how: {r["row_idx"]: r for r in detector.score_baseline(df, **how).collect()}
    exact, own = score(), score(exact=False)
    parts = [detector.sketch_logs(df.where(F.col("source") == s)) for s in ("s0", "s1", "s2")]
    known = score(known=detector.merge_sketches(parts))
    for other in (own, known):
        assert other[77]["flagged"] and other.keys() == exact.keys()
        assert max(abs(other[i]["anomaly_score"] / exact[i]["anomaly_score"] - 1) for i in exact) < 0.05
    assert detector.score_baseline(df, ["source"], exact=False).count() == 3000
