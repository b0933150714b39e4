"""Poisson counts, exact replication, target shares."""

import math
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from flightseal.llm import mixing
from flightseal.llm.queries import op8_mixing
from tests.conftest import SF


def plain_invert(u, mean):
    k, total = 0, math.exp(-mean)
    term = total
    while total < u and k < 2000:
        k += 1
        term *= mean / k
        total += term
    return k


def test_invert_and_draws():
    rng = np.random.default_rng(2)
    u, mean = rng.random(3000), rng.choice([0.0, 0.1, 1.0, 7.5, 200.0], 3000)
    assert mixing.invert(u, mean).tolist() == [plain_invert(a, b) for a, b in zip(u, mean)]
    assert mixing.invert(np.array([1 - 1e-16]), np.array([3.0]))[0] < 60
    hashes = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    for value in (0.3, 2.0, 700.0):
        counts = mixing.draws(hashes, np.full(20000, value))
        assert abs(counts.mean() - value) < 4 * math.sqrt(value / 20000) and abs(counts.var() / value - 1) < 0.06
    assert mixing.draws(hashes[:2], np.array([np.nan, -1.0])).tolist() == [0, 0]


def test_shares_and_copies(spark):
    rows = [(i, f"text {i % 50:04d}", "hot" if i % 3 else f"s{i % 4}", -1) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    got = mixing.replicate(docs).collect()
    share = Counter(r.source for r in got)
    assert len(share) == 5 and all(abs(n / len(got) - 0.2) < 0.03 for n in share.values())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(c) == list(range(len(c))) for c in by.values())
    again = mixing.replicate(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.copy) for r in again) == sorted((r.doc_id, r.copy) for r in got)
    only = mixing.replicate(docs, {"s1": 2.0, "gone": 0.0})
    assert {r.source for r in only.select("source").distinct().collect()} == {"s1"}


def test_order_is_unlike_the_input(spark):
    docs = spark.createDataFrame([(i, "x", "a") for i in range(5000)], "doc_id long, text string, source string")
    ids = np.array([r.doc_id for r in mixing.replicate(docs).collect()])
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.08


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (None, "", "a"), (2, "y" * 99999, "b"), (2, "y" * 99999, "b")], "doc_id long, text string, source string")
    got = mixing.replicate(docs).collect()
    assert {r.source for r in got} <= {"b"} and len(got) % 2 == 0
    assert mixing.replicate(docs.limit(0)).count() == 0


def test_query(spark):
    """Every document's copies, against counts inverted one at a time from the same hashes and rates worked out plainly."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", F.xxhash64(F.lit(29), "doc_id", "text").alias("h")).collect()
    size = Counter()
    for r in rows:
        size[r.source] += len((r.text or "").encode())
    share = sum(size.values()) / sum(1 for n in size.values() if n)
    wanted = {}
    for r in rows:
        mean = share / size[r.source] if size[r.source] else 0.0
        assert mean <= mixing.PART
        u = float(mixing.uniforms(np.array([r.h], np.int64).view(np.uint64), 0)[0])
        if n := plain_invert(u, mean):
            wanted[r.doc_id] = list(range(n))
    got = {}
    for r in op8_mixing(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r.copy)
    assert {i: sorted(c) for i, c in got.items()} == wanted


def test_small_source_is_copied_by_many_tasks(spark):
    docs = spark.createDataFrame([(0, "x", "tiny", 7, 8)] + [(i, "y" * 500, "big", 7, 8) for i in range(1, 61)], "doc_id long, text string, source string, copies_ int, part_ int")
    mixed = mixing.replicate(docs)
    tiny = [r for r in mixed.where("source = 'tiny'").collect()]
    assert len(tiny) > 10 * mixing.RANGE and sorted(r.copy for r in tiny) == list(range(len(tiny)))
    assert abs(len(tiny) / 15000 - 1) < 0.05 and {(r.copies_, r.part_) for r in tiny} == {(7, 8)}
    assert 10 < mixed.where("source = 'big'").count() < 60
