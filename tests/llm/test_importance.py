"""Scores against a plain version, radix ranks against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from flightseal.llm import importance, radix
from flightseal.llm.queries import op12_importance
from flightseal.session import materialize
from tests.conftest import SF

MASK = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, longest):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = MASK.findall(lower)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *plain_features(t, longest)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in plain_features(x, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for i, n, fs in own:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fitting = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(fitting) * percent // 100
    return sorted(map(str, [[*r[:1], *r[2:], k + 1 if k < drawn else None] for k, r in enumerate(fitting)] + [[*r[:1], *r[2:], None] for r in rows if r[1] < least]))


def flat(df):
    return sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in df.collect())


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert flat(op12_importance(spark, SF)) == plain(docs, target)


@pytest.mark.parametrize("longest, buckets, percent", [(1, 50, 100), (3, 70_000, 33)])
def test_odd_rows(spark, longest, buckets, percent):
    rng = random.Random(3)
    texts = [None, "", "é É ſ", "A-b_C 1.5", "x\x00y z", "w " * 30000] + [" ".join(rng.choice(["Aa", "bb", "cé", "d4"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    docs = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(8, texts[8]), (-5, texts[9])]
    target = ["aa bb", None, "", "cé zz"]
    rows = [(*d, 1, 2, 3) for d in docs]
    table = spark.createDataFrame(rows, "doc_id long, text string, rank int, block_ int, key int")
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, features int")
    got = importance.resample(table, wanted, percent, 5, longest, buckets)
    assert flat(got) == plain(docs, target, percent, 5, longest, buckets)
    assert importance.resample(table.limit(0), wanted).count() == 0
    none = importance.resample(table, wanted.limit(0), 50, 5)
    assert flat(none) == plain(docs, [], 50, 5)


KEYS = [
    [(0, 5), (0, 5), (None, 1), (3, None), (None, None)],
    [(-(1 << 63), 1), ((1 << 63) - 1, -1), (0, 0), (-1, 7), (5, 5), (None, 2), (1, -(1 << 63)), (1, (1 << 63) - 1)],
    [(7, 7)] * 9,
    [],
]


@pytest.mark.parametrize("rows", [*KEYS, [(random.Random(i).randrange(50), random.Random(-i).randrange(1 << 40)) for i in range(700)]])
@pytest.mark.parametrize("falls", [(True, False), (False, True)])
def test_ranks(spark, rows, falls):
    df = materialize(spark.createDataFrame([(*r, 1, 2) for r in rows], "a long, b long, digit_ int, place int"), "radix-test")
    got = radix.ranked(df, [("a", falls[0]), ("b", falls[1])], "rank", 7, 60)
    assert got.columns == ["a", "b", "digit_", "place", "rank"]
    own = lambda x, f: (x is None, 0 if x is None else -x if f else x)
    wanted = sorted(rows, key=lambda r: (own(r[0], falls[0]), own(r[1], falls[1])))
    assert [(r.a, r.b) for r in sorted(got.collect(), key=lambda r: r["rank"])] == wanted
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, len(rows) + 1))
