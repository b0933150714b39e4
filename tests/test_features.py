"""Feature rules, by hand and against brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from flightseal.constants import DERIVED_FEATURES, FEATURES, LOCATION_FEATURES
from flightseal.operators.features import engineer_features, feature_matrix, without_location
from tests.brute import flight_features

SCHEMA = """case_id int, row_idx int, timestamp timestamp, latitude double, longitude double,
 altitude double, speed double, heading double"""


def at(seconds):
    return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def table(spark, rows):
    return spark.createDataFrame(
        [
            (r["case_id"], r["row_idx"], None if r["t"] is None else at(r["t"]), r["latitude"], r["longitude"],
             r["altitude"], r["speed"], r["heading"])
            for r in rows
        ],
        SCHEMA,
    )


def row(case, idx, t, **values):
    base = dict(latitude=8.0, longitude=98.0, altitude=10.0, speed=1.0, heading=0.0)
    return dict(case_id=case, row_idx=idx, t=t, **{**base, **values})


def one(spark, rows, *names):
    out = engineer_features(table(spark, rows)).orderBy("case_id", "row_idx")
    return [tuple(r) for r in out.select(*names).collect()]


def test_first_row_has_no_predecessor(spark):
    assert one(spark, [row(0, 0, 5.0)], "dt_s", "ts_gap_flag", "d_alt_m", "row_frac", "roll_std_speed", "roll_dev_speed") == [
        (None, 0, None, None, None, 0.0)
    ]


def test_time_is_capped_above_only(spark):
    rows = [row(0, 0, 0.0), row(0, 1, 1.7e9), row(0, 2, 1.7e9 - 30), row(0, 3, 1.7e9 + 31)]
    assert one(spark, rows, "dt_s", "ts_gap_flag") == [(None, 0), (3600.0, 1), (-30.0, 0), (61.0, 1)]


def test_rates_use_the_uncapped_time_and_zero_gives_missing(spark):
    rows = [row(0, 0, 0.0, speed=0.0), row(0, 1, 7200.0, speed=72.0, altitude=82.0), row(0, 2, 7200.0, speed=80.0)]
    assert one(spark, rows, "accel_mps2", "alt_rate_mps", "speed_gps_mps") == [
        (None, None, None),
        (0.01, 0.01, 0.0),
        (None, None, None),
    ]


def test_turns_are_in_half_open_range(spark):
    headings = [350.0, 10.0, 350.0, 170.0, 350.0, 349.5]
    rows = [row(0, i, float(i), heading=h) for i, h in enumerate(headings)]
    assert [r[0] for r in one(spark, rows, "d_heading_deg")] == [None, 20.0, -20.0, -180.0, -180.0, -0.5]


def test_nan_and_infinity_are_missing(spark):
    rows = [row(0, 0, 0.0, speed=math.nan), row(0, 1, 1.0, speed=math.inf), row(0, 2, 2.0, speed=3.0)]
    assert one(spark, rows, "speed", "speed_resid_mps", "roll_dev_speed") == [
        (None, None, None),
        (None, None, None),
        (3.0, 3.0, 0.0),
    ]


def test_missing_position_gives_no_distance(spark):
    rows = [row(0, 0, 0.0, latitude=None), row(0, 1, 1.0), row(0, 2, 2.0)]
    assert one(spark, rows, "dist_m", "d_lat_deg") == [(None, None), (None, None), (0.0, 0.0)]


def test_feature_list():
    assert len(FEATURES) == len(set(FEATURES)) == 25
    assert not {"case_id", "row_idx", "label", "tamper_type", "timestamp", "source"} & set(FEATURES)
    assert without_location() == [f for f in FEATURES if f not in LOCATION_FEATURES]
    assert len(without_location()) == 21


def test_matrix_types(spark):
    matrix = feature_matrix(engineer_features(table(spark, [row(0, 0, 0.0)])), ["case_id"])
    assert matrix.columns == ["case_id", *FEATURES]
    assert {t for c, t in matrix.dtypes if c not in ("case_id", "ts_gap_flag")} == {"float"}
    assert dict(matrix.dtypes)["ts_gap_flag"] == "tinyint"


@pytest.fixture(scope="module")
def random_rows():
    random.seed(11)
    rows = []
    for case, length in enumerate([1, 3, 12, 45, 80]):
        t, idx = 0.0, 0
        for i in range(length):
            blank = (lambda v: None if random.random() < 0.05 else v)
            rows.append(
                dict(
                    case_id=case, row_idx=idx, t=t,
                    latitude=blank(8 + random.random() / 100), longitude=blank(98 + random.random() / 100),
                    altitude=blank(random.random() * 50), speed=blank(random.random() * 10),
                    heading=blank(random.random() * 360),
                )
            )
            t += random.choice([0.0, 0.1, 0.1, 1.0, -2.0, 70.0, 5000.0])
            idx += random.choice([1, 1, 1, 30]) if case == 4 else 1
    return rows


@pytest.mark.parametrize("limit", [None, 20, 4])
def test_against_brute_force(spark, random_rows, limit):
    shuffled = random_rows[:]
    random.Random(5).shuffle(shuffled)
    df = table(spark, shuffled).withColumn("tag", F.concat(F.lit("r"), F.col("row_idx").cast("string"))).repartition(4)
    got = {
        (r["case_id"], r["row_idx"]): r
        for r in engineer_features(df, limit=limit).select("case_id", "row_idx", "tag", *DERIVED_FEATURES).collect()
    }
    assert len(got) == len(random_rows)
    for case in range(5):
        flight = [r for r in random_rows if r["case_id"] == case]
        for r, expected in zip(flight, flight_features(flight)):
            mine = got[(case, r["row_idx"])]
            assert mine["tag"] == f"r{r['row_idx']}"
            for name in DERIVED_FEATURES:
                if expected[name] is None:
                    assert mine[name] is None, (case, r["row_idx"], name)
                else:
                    assert mine[name] == pytest.approx(expected[name], rel=1e-9, abs=1e-9), (case, r["row_idx"], name)


def test_flights_do_not_affect_each_other(spark, random_rows):
    some = [r for r in random_rows if r["case_id"] in (2, 3)]
    alone = engineer_features(table(spark, some)).orderBy("case_id", "row_idx").select(*DERIVED_FEATURES)
    together = engineer_features(table(spark, random_rows)).where("case_id in (2, 3)").orderBy("case_id", "row_idx")
    assert alone.collect() == together.select(*DERIVED_FEATURES).collect()


def test_plan_has_one_exchange_and_no_python(spark, random_rows):
    df = table(spark, random_rows)
    path = spark.conf.get("spark.checkpoint.dir") + "/plan.parquet"
    df.write.mode("overwrite").parquet(path)
    plan = engineer_features(spark.read.parquet(path)).select("case_id", *DERIVED_FEATURES)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "Python" not in text and "Join" not in text
