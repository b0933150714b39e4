"""Rule statistics against a plain version; the forest against held-out labels."""

import random
import re

import numpy as np

from flightseal.llm import quality
from flightseal.llm.queries import op3_quality
from tests.conftest import SF


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "é b c d", "x|y #", "\n\nA b\nA b\n \nA b\x0c"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))).replace("b a", "b\na") for _ in range(60)]
    assert [quality.statistics(t)[:5] for t in texts] == [plain(t) for t in texts]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op3_quality(spark, SF).collect()
    assert {r.doc_id: tuple(r[1:6]) for r in got} == {i: plain(t) for i, t in docs.items()}
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_forest_finds_held_out_junk():
    rng = np.random.default_rng(3)

    def rows(n, symbols):
        words = rng.integers(50, 500, n)
        return np.stack([words, words * 5, (words * symbols).astype(int), words * 0, words * 0, words // 10, words * 0], 1)

    forest = quality.fit(rows(5000, 0), 1)
    good, bad = quality.steps(forest, rows(2000, 0), 256), quality.steps(forest, rows(500, 0.5), 256)
    found = {(1, s): n for s, n in zip(*np.unique(good, return_counts=True))} | {(0, s): n for s, n in zip(*np.unique(bad, return_counts=True))}
    limit = quality.threshold({k: int(n) for k, n in found.items()}, 0.005)
    fresh_good, fresh_bad = quality.steps(forest, rows(2000, 0), 256), quality.steps(forest, rows(500, 0.5), 256)
    assert (fresh_good > limit).mean() < 0.02 and (fresh_bad > limit).mean() > 0.95


def test_threshold():
    assert quality.threshold({(0, 9): 5, (1, 8): 1, (0, 7): 3, (1, 1): 99}, 0.0) == 8
    assert quality.threshold({(0, 9): 5, (1, 8): 1, (0, 7): 3, (1, 1): 99}, 0.01) == 6
    assert quality.threshold({}, 0.1) == quality.SCORE_STEPS


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, text, 2.0), (3, text, 2.0), (None, text, 3.0), (4, "a " * 50000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 1), (77, 0)], "doc_id long, quality int")
    got = sorted((r.doc_id or 0, r.kept) for r in quality.judge(docs, labels).collect())
    assert got == [(0, True), (1, False), (2, False), (3, True), (3, True), (4, False)]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 3
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == 3


def test_labels_of_bad_rows_only_reject_nothing(spark):
    assert quality.threshold({(0, 0): 5}, 0.005) == quality.SCORE_STEPS
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "a b"), (4, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    assert {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()} == {1, 2}
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {1, 2}
