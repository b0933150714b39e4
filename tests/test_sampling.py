"""Splits, samples and thinning: sizes, strata, determinism."""

import random

import pytest
from pyspark.sql import functions as F

from flightseal.operators import resample, sampling
from flightseal.workload.sampling_queries import ROW_HASH, SAMPLE_ROWS, stratified_sample, uniform_sample
from flightseal.workload.view import telemetry
from tests.conftest import SF
from tests.test_features import row, table


@pytest.fixture(scope="module")
def flights60(spark):
    """60 flights, five of them normal, of 3 to 40 rows."""
    random.seed(1)
    rows = [
        (case, i, int(case >= 5 and i % 3 == 0))
        for case in range(60)
        for i in range(random.randrange(3, 40))
    ]
    return spark.createDataFrame(rows, "case_id int, row_idx int, label int").repartition(7)


def test_split_sizes(flights60):
    split = sampling.case_split(flights60)
    sizes = {(r["is_holdout"], r["case_label"]): r["count"] for r in split.groupBy("is_holdout", "case_label").count().collect()}
    assert sizes == {(False, 1): 44, (False, 0): 4, (True, 1): 11, (True, 0): 1}
    assert split.select("case_id").distinct().count() == split.count() == 60


def test_split_ignores_partitioning_and_depends_on_seed(flights60):
    def held(df, seed=42):
        return {r[0] for r in sampling.case_split(df, seed=seed).where("is_holdout").collect()}

    assert held(flights60) == held(flights60.repartition(2, "row_idx")) == held(flights60.orderBy("label"))
    assert held(flights60) != held(flights60, 43)


def test_split_within_groups(flights60):
    grouped = flights60.withColumn("replicate", F.col("case_id") % 3)
    split = sampling.case_split(grouped, ["replicate", "case_id"], ["replicate"])
    assert {r[0]: r[1] for r in split.where("is_holdout").groupBy("replicate").count().collect()} == {0: 4, 1: 4, 2: 4}


def test_rows_of_keeps_whole_flights(flights60):
    split = sampling.case_split(flights60)
    train = sampling.rows_of(flights60, split.where("not is_holdout"))
    held = sampling.rows_of(flights60, split.where("is_holdout"))
    assert train.count() + held.count() == flights60.count()
    assert not {r[0] for r in train.select("case_id").distinct().collect()} & {
        r[0] for r in held.select("case_id").distinct().collect()
    }


@pytest.mark.parametrize("rows", [1, 17, 300])
def test_stratified_sample(flights60, rows):
    sample = sampling.stratified_sample(flights60, rows)
    total = flights60.count()
    positive = flights60.where("label = 1").count()
    got = sample.where("label = 1").count()
    assert sample.count() == rows and sample.distinct().count() == rows
    assert abs(got - rows * positive / total) < 1
    assert set(sample.columns) == set(flights60.columns)


def test_uniform_sample(flights60):
    assert sampling.uniform_sample(flights60, 100).distinct().count() == 100
    assert sampling.uniform_sample(flights60, flights60.count()).count() == flights60.count()
    whole, other = (sampling.uniform_sample(x, 50).collect() for x in (flights60, flights60.coalesce(1)))
    assert {tuple(r) for r in whole} == {tuple(r) for r in other}


@pytest.mark.parametrize("draw", [sampling.uniform_sample, sampling.stratified_sample])
def test_a_sample_never_shrinks_silently(flights60, draw):
    with pytest.raises(Exception, match="larger than the rows"):
        draw(flights60, flights60.count() + 1).collect()


@pytest.mark.parametrize("shift", [0, 40])
def test_quota_paths_agree(flights60, shift, spark):
    """Numbering whole strata, or only slices of the hash; also when all hashes share one slice."""
    rank = F.shiftrightunsigned(sampling.spread_hash(["case_id", "row_idx"]), shift)
    quotas = spark.createDataFrame([(0, 120), (1, 33)], "label int, quota long")
    args = (flights60, ["label"], quotas, rank, ["case_id", "row_idx"])
    direct = {tuple(r) for r in sampling.take_quota(*args, rows=10).select("case_id", "row_idx").collect()}
    sliced = {tuple(r) for r in sampling.take_quota(*args).select("case_id", "row_idx").collect()}
    assert direct == sliced and len(direct) == 153


def test_equal_remainders_go_to_the_smaller_label(spark):
    sizes = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "label int, n long")
    quotas = sampling.proportional_quotas(sizes, [], "label", F.lit(8))
    assert {r["label"]: r["quota"] for r in quotas.collect()} == {0: 3, 1: 3, 2: 2}


def test_class_weights(flights60):
    weights = {r["label"]: r for r in sampling.class_weights(flights60).collect()}
    total = sum(w["n"] for w in weights.values())
    for w in weights.values():
        assert w["weight"] == pytest.approx(total / (2 * w["n"]))
    weighted = sampling.with_class_weights(flights60).agg(F.sum("weight")).first()[0]
    assert weighted == pytest.approx(total)


@pytest.mark.parametrize("limit", [None, 6])
def test_thin(spark, flights60, limit):
    assert {tuple(r) for r in sampling.case_labels(flights60).collect()} == {(c, int(c >= 5)) for c in range(60)}
    same = resample.thin(flights60, 1, limit=limit)
    assert {tuple(r) for r in same.collect()} == {tuple(r) for r in flights60.collect()}
    sparse = flights60.withColumn("was", F.col("row_idx")).withColumn("row_idx", F.col("row_idx") * 3 + 2)
    thinned = resample.thin(sparse, 4, limit=limit)
    assert dict(thinned.dtypes)["row_idx"] == "int"
    assert {(r["case_id"], r["row_idx"], r["was"]) for r in thinned.collect()} == {
        (r["case_id"], r["row_idx"] // 4, r["row_idx"]) for r in flights60.collect() if r["row_idx"] % 4 == 0
    }


def test_step_rounds_half_to_even(spark):
    for gap, step in ((0.1, 20), (0.8, 2), (0.5714285714285714, 4), (4.0, 1), (100.0, 1), (1.3333333333333333, 2)):
        df = table(spark, [row(0, i, i * gap) for i in range(5)])
        got = resample.sampling_interval(df).first()
        assert got["step"] == max(1, round(2.0 / got["median_dt_s"])) == step


@pytest.mark.parametrize("shift, limit", [(0, 5), (40, 5), (62, 5), (40, 100_000)])
def test_refined_slices_and_repeated_rows(spark, flights60, shift, limit):
    """The cut slice is counted by further bits; rows that share every key are told apart only by number."""
    rank = F.shiftrightunsigned(sampling.spread_hash(["case_id", "row_idx"]), shift)
    doubled = flights60.unionByName(flights60).unionByName(flights60)
    for rows, wanted in ((flights60, [(0, 120), (1, 33)]), (doubled, [(0, 121), (1, 35)]), (doubled, [(0, 1), (1, 0)])):
        quotas = spark.createDataFrame(wanted, "label int, quota long")
        args = (rows, ["label"], quotas, rank, ["case_id", "row_idx"])
        direct = sorted(map(tuple, sampling.take_quota(*args, rows=10).select("case_id", "row_idx").collect()))
        spark.conf.set("spark.flightseal.windowRows", str(limit))
        try:
            cut = sorted(map(tuple, sampling.take_quota(*args).select("case_id", "row_idx").collect()))
        finally:
            spark.conf.unset("spark.flightseal.windowRows")
        assert cut == direct and len(cut) == sum(n for _, n in wanted)


def test_a_sample_shuffles_no_rows(spark, flights60):
    path = spark.conf.get("spark.checkpoint.dir") + "/sampled.parquet"
    flights60.write.mode("overwrite").parquet(path)
    sample = sampling.uniform_sample(spark.read.parquet(path), 100)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_row_hash_of_large_flight_numbers(spark):
    """The rank of the sample queries is the product's remainder also where the product leaves 64 bits."""
    keys = [(c, r) for c in (0, 7, 34_744, 34_745, 89_999, 539_999, 2**31 - 1) for r in (0, 1, 5_000)] + [(-3, 2), (-90_000, 0)]
    rows = spark.createDataFrame(keys, "case_id int, row_idx int")
    got = {(r["case_id"], r["row_idx"]): r["rank"] for r in rows.selectExpr("*", f"{ROW_HASH} as rank").collect()}
    for (case, row), rank in got.items():
        product = (case * 100003 + row) * 2654435761
        assert rank == (product % 2**32 if product >= 0 else -(-product % 2**32)) * 2**31
    assert len(got) == len(keys)


@pytest.mark.parametrize("draw", [stratified_sample, uniform_sample])
def test_sample_queries_of_large_flight_numbers(spark, tmp_path, draw):
    """Events of users from 40,000 on, as larger tables have them."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("user_id") + 40_000)
    events.write.parquet(f"{tmp_path}/events.parquet")
    key = lambda r: ((r["case_id"] * 100003 + r["row_idx"]) * 2654435761 % 2**32, r["case_id"], r["row_idx"])
    rows = telemetry(spark, str(tmp_path)).select("case_id", "row_idx", "label").collect()
    got = [tuple(r) for r in draw(spark, str(tmp_path)).select("case_id", "row_idx", "label").collect()]
    assert len(got) == SAMPLE_ROWS == len(set(got))
    groups = [rows] if draw is uniform_sample else [[r for r in rows if r["label"] == label] for label in (0, 1)]
    for group in groups:
        drawn = sorted(key(r) for r in group if tuple(r) in set(got))
        assert drawn == sorted(map(key, group))[: len(drawn)]
