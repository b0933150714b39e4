"""Links against brute force: recall, no false ones, components."""

import numpy as np

from flightseal.llm import embedding
from flightseal.llm.queries import op7_embedding


def brute(rows, threshold=0.93):
    """{vec_id: set of linked vec_ids}"""
    fit = [(i, l, np.array(v, float)) for i, v, l in rows if l is not None and embedding.usable(v)]
    out = {i: set() for i, _, _ in rows}
    for label in {l for _, l, _ in fit}:
        own = [(i, v) for i, l, v in fit if l == label]
        unit = np.stack([v / np.linalg.norm(v) for _, v in own])
        for a, b in zip(*np.nonzero(unit @ unit.T >= threshold)):
            if a != b:
                out[own[a][0]].add(own[b][0])
    return out


def smallest(links):
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in root:
                    root[j] = i
                    todo += links[j]
    return root


def check(rows, got, least=0.99):
    links = brute(rows)
    total, found = sum(map(len, links.values())), sum(r.n_links for r in got)
    assert len(got) == len(rows)
    assert all(r.n_links <= len(links[r.vec_id]) for r in got)
    assert found >= least * total
    if found == total:
        root = smallest(links)
        assert all((r.component_id, r.kept) == (root[r.vec_id], root[r.vec_id] == r.vec_id) for r in got)
    return found, total


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(rows, op7_embedding(spark, folder).collect())


def test_groups_near_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(60):
        base = rng.normal(size=64)
        for _ in range(8):
            rows.append((len(rows), (base + rng.normal(size=64) * rng.choice([0.0, 0.1, 0.25])).tolist(), int(rng.integers(2))))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found, total = check(rows, embedding.near_duplicates(frame).collect(), 0.97)
    assert total > 500


def test_rotation_balances_codes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64)) * np.linspace(0.2, 3, 64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rotation = embedding.learn(x)
    bits = np.unpackbits(embedding.codes(x, rotation).view(np.uint8).reshape(-1, 8), axis=1)
    assert (abs(bits.mean(0) - 0.5) < 0.15).all()


def test_odd_rows(spark):
    one, nan = [1.0, 2.0, 0.0], float("nan")
    rows = [(1, one, 3), (2, [2.0, 4.0, 0.0], 3), (3, one, 4), (4, one, None), (5, None, 3), (6, [], 3), (7, [0.0] * 3, 3), (8, [nan, 1.0, 1.0], 3),
            (9, [float("inf"), 1.0, 1.0], 3), (10, [None, 1.0, 2.0], 3), (11, [1e200, 2e200, 0.0], 3), (12, [1.0, 2.0], 3), (13, [1.0, 2.01, 0.0], 3)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(frame).collect()}
    assert got == {i: (0, i, True) for i in range(3, 13)} | {1: (3, 1, True), 2: (3, 1, False), 11: (3, 1, False), 13: (3, 1, False)}
    twice = embedding.near_duplicates(frame.union(frame)).collect()
    assert len(twice) == 26
    assert embedding.near_duplicates(frame.limit(0)).count() == 0
