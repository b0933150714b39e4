"""Cut flights must give what uncut windows give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flightseal.operators.ordering import filled, flights, with_position, with_previous


@pytest.fixture(scope="module")
def rows(spark):
    """Flights of 1 to 90 rows, one with far apart order values, sparse text."""
    random.seed(3)
    data = []
    for case, length in enumerate([1, 2, 9, 10, 11, 40, 90, 25]):
        at = 0
        for _ in range(length):
            data.append((case, at, random.random(), random.choice([None, None, None, "a", "b"])))
            at += random.choice([1, 1, 7, 60]) if case == 7 else 1
    random.shuffle(data)
    data += [(8, i, float(i), None) for i in range(30)]
    data += [(9, i, float(i), "late" if i == 29 else None) for i in range(30)]
    return spark.createDataFrame(data, "case_id int, row_idx int, value double, text string").repartition(5)


def collect(df, *columns):
    return sorted(map(tuple, df.select("case_id", "row_idx", *columns).collect()))


def test_short_flights_keep_the_plain_plan(rows):
    assert not flights(rows, ["case_id"], "row_idx").cut
    assert flights(rows, ["case_id"], "row_idx", 50).cut


@pytest.mark.parametrize("limit", [None, 64, 8, 1])
def test_position(rows, limit):
    expected = rows.withColumn(
        "p", F.row_number().over(Window.partitionBy("case_id").orderBy("row_idx")) - 1
    )
    assert collect(with_position(rows, ["case_id"], "row_idx", "p", limit), "p") == collect(expected, "p")


@pytest.mark.parametrize("limit", [None, 64, 8, 1])
def test_previous(rows, limit):
    expected = rows.withColumn("p", F.lag("value").over(Window.partitionBy("case_id").orderBy("row_idx")))
    got = with_previous(rows, ["case_id"], "row_idx", {"value": "p"}, limit)
    assert repr(collect(got, "p")) == repr(collect(expected, "p"))


@pytest.mark.parametrize("limit", [None, 64, 8, 1])
def test_fill(rows, limit):
    window = Window.partitionBy("case_id").orderBy("row_idx")
    expected = rows.withColumn(
        "text",
        F.coalesce(
            F.last("text", True).over(window.rowsBetween(Window.unboundedPreceding, 0)),
            F.first("text", True).over(window.rowsBetween(0, Window.unboundedFollowing)),
        ),
    )
    got = filled(rows, ["case_id"], "row_idx", "text", limit)
    assert repr(collect(got, "text")) == repr(collect(expected, "text"))
    assert all(r.text is None for r in got.where("case_id = 8").collect())
    assert {r.text for r in got.where("case_id = 9").collect()} == {"late"}


UNCLEAR = {
    "repeated": lambda i, n: 7,
    "few values": lambda i, n: i // 40,
    "sparse": lambda i, n: i * 1000,
    "missing": lambda i, n: None if i % 3 else i,
    "ordinary": lambda i, n: i,
}


@pytest.fixture(scope="module")
def unclear(spark):
    """Flights of 200 rows whose order values repeat, are far apart or missing; `seq` orders them all."""
    random.seed(8)
    data = []
    for case, place in enumerate(UNCLEAR.values()):
        data += [(case, place(i, 200), i, random.random(), random.choice([None, None, "a", "b"])) for i in range(200)]
    random.shuffle(data)
    return spark.createDataFrame(data, "case_id int, row_idx int, seq int, value double, text string").repartition(6)


@pytest.mark.parametrize("limit", [16, 7])
def test_no_block_above_the_limit(unclear, limit):
    data = flights(unclear, ["case_id"], "row_idx", limit, ["seq"])
    blocks = data.rows.groupBy("case_id", "_block").count().collect()
    assert max(r["count"] for r in blocks) == limit
    assert len(blocks) == 5 * -(-200 // limit)  # and none is needlessly small
    assert data.rows.count() == unclear.count()
    repeated = unclear.where("case_id = 0").drop("seq", "value", "text")  # rows that are equal in all
    equal = flights(repeated, ["case_id"], "row_idx", limit).rows.groupBy("_block").count().collect()
    assert max(r["count"] for r in equal) == limit


@pytest.mark.parametrize("limit", [None, 16, 7])
def test_ties_decide(unclear, limit):
    window = Window.partitionBy("case_id").orderBy(F.col("row_idx").asc_nulls_first(), "seq")
    wanted = unclear.withColumns({"p": F.row_number().over(window) - 1, "before": F.lag("value").over(window)})
    wanted = wanted.withColumn("text", F.coalesce(
        F.last("text", True).over(window.rowsBetween(Window.unboundedPreceding, 0)),
        F.first("text", True).over(window.rowsBetween(0, Window.unboundedFollowing)),
    ))
    rows = lambda df, name: sorted(map(repr, df.select("case_id", "seq", name).collect()))
    args = (["case_id"], "row_idx")
    assert rows(with_position(unclear, *args, "p", limit, ["seq"]), "p") == rows(wanted, "p")
    assert rows(with_previous(unclear, *args, {"value": "before"}, limit, ["seq"]), "before") == rows(wanted, "before")
    assert rows(filled(unclear, *args, "text", limit, ["seq"]), "text") == rows(wanted, "text")
