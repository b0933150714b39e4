"""Exact shard sizes, gapless slots, and the law of the matrix."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from flightseal.llm import sharding
from flightseal.llm.queries import op9_sharding
from tests.conftest import SF


def check(rows, total, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, slots.values())) == total
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib

    got = op9_sharding(spark, SF).collect()
    check(got, len(docs), 8)
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in docs.items()}


def test_matrix_has_exact_margins():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 30, 37)
    ends = np.concatenate([[0], np.cumsum(counts)])
    places = sharding.shard_sizes(int(counts.sum()), 8)
    rows = np.array([sharding.matrix_row(b, ends, places, 5) for b in range(37)])
    assert (rows.sum(1) == counts).all() and (rows.sum(0) == places).all() and (rows >= 0).all()


def test_entries_follow_the_hypergeometric_law():
    ends, places = np.array([0, 6, 10, 20]), np.array([10, 10])
    first = [sharding.matrix_row(0, ends, places, seed)[0] for seed in range(4000)]
    rng = np.random.default_rng(0)
    wanted = rng.hypergeometric(10, 10, 6, 200000)
    for k in range(7):
        assert abs(np.mean(np.array(first) == k) - np.mean(wanted == k)) < 0.03
    big = [sharding._by_inverse(u, 50, 70, 40) for u in rng.random(20000)]
    wanted = rng.hypergeometric(50, 70, 40, 200000)
    assert abs(np.mean(big) - wanted.mean()) < 0.1 and abs(np.var(big) / wanted.var() - 1) < 0.06


def test_many_blocks_and_odd_rows(spark):
    rows = [(i % 400 if i % 7 else None, i % 3) for i in range(1500)]
    frame = spark.createDataFrame(rows, "k long, slot int")
    got = sharding.assign(frame, "k", 4, block_rows=16).collect()
    check(got, 1500, 4)
    assert Counter(r.k for r in got) == Counter(k for k, _ in rows)
    check(sharding.assign(frame.limit(3), "k", 8).collect(), 3, 8)
    assert sharding.assign(frame.limit(0), "k", 8).count() == 0


def test_levels_and_columns_named_like_helpers(spark, monkeypatch):
    """Three levels of three branches have the exact margins, and a null key in a third of the rows shares no block."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 20, 25)
    counts = spark.createDataFrame([(b, int(n)) for b, n in enumerate(sizes) if n], "node long, rows long")
    places = sharding.shard_sizes(int(sizes.sum()), 4)
    got = {r.node: np.diff(r.ends, prepend=0) for r in sharding.matrix(counts, 25, places, 7, fan=3).collect()}
    assert {b: n for b, n in enumerate(sizes) if n} == {b: row.sum() for b, row in got.items()}
    assert (sum(got.values()) == places).all() and all((row >= 0).all() for row in got.values())

    names = ("k", "local_", "block_", "ends_", "chunk_", "own_", "rows_", "start_")
    rows = [(None if i % 3 == 0 else i, *[i] * 7) for i in range(900)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    largest = []

    def seen(counts, *rest):
        largest.append(counts.agg(F.max("rows")).first()[0])
        return real(counts, *rest)

    real = sharding.matrix
    monkeypatch.setattr(sharding, "matrix", seen)
    got = sharding.assign(frame, "k", 4, block_rows=32, fan=4).collect()
    check(got, 900, 4)
    assert sorted(r.local_ for r in got) == list(range(900)) and largest[0] < 80
