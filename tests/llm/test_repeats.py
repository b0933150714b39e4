"""Maximal repeats and removed bytes against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from flightseal.llm import repeats, substring
from tests.conftest import SF


def plain_removed(docs, length):
    """{doc: set of removed places}; docs: {id: bytes}."""
    seen, gone = set(), {i: set() for i in docs}
    for i in sorted(docs):
        for at in range(len(docs[i]) - length + 1):
            window = docs[i][at : at + length]
            if window in seen:
                gone[i].update(range(at, at + length))
            seen.add(window)
    return gone


def plain_report(docs, length=100):
    out = {}
    for i, places in plain_removed(docs, length).items():
        kept = bytes(b for at, b in enumerate(docs[i]) if at not in places)
        n = sum(at - 1 not in places for at in places)
        out[i] = (len(docs[i]), len(places), n, hashlib.sha256(kept).hexdigest())
    return out


def as_dict(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_maximal_repeats():
    rng = random.Random(4)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(12, 30))) for _ in range(4)]
        texts += [texts[0][2:], texts[1] + b"a"]
        length = 5
        got = {}
        for size, number, place in repeats.maximal_repeats(texts, [max(0, len(t) - length + 1) for t in texts], length):
            assert size >= length
            words = {texts[n][p : p + size] for n, p in zip(number, place)}
            assert len(words) == 1
            got[words.pop()] = set(zip(number.tolist(), place.tolist()))
        wanted = {}
        for n, t in enumerate(texts):
            for p in range(len(t)):
                for size in range(length, len(t) - p + 1):
                    wanted.setdefault(t[p : p + size], set()).add((n, p))
        maximal = {}
        for word, places in wanted.items():
            left = {(texts[n][p - 1] if p else (n, p)) for n, p in places}
            right = {(texts[n][p + len(word)] if p + len(word) < len(texts[n]) else (n, p)) for n, p in places}
            if len(places) > 1 and len(left) > 1 and len(right) > 1:
                maximal[word] = places
        assert got == maximal


def test_runs_cover_every_window_once_and_by_content():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8).tobytes()
    data = data[:1000] + data[200:700] + data[1000:]
    ends = np.array([1500, 1530, len(data)])
    key, anchor, start, count = repeats.runs(data, ends, 60, 20)
    windows = [s + i for s, n in zip(start.tolist(), count.tolist()) for i in range(n)]
    assert windows == [p for a, b in ((0, 1500), (1530, len(data))) for p in range(a, b - 59)]
    by = {}
    for k, a, s, n in zip(key.tolist(), anchor.tolist(), start.tolist(), count.tolist()):
        for p in range(s, s + n):
            by.setdefault(data[p : p + 60], set()).add((k, a - p))
    assert all(len(v) == 1 for v in by.values())


def made(n=60, seed=7):
    rng = random.Random(seed)
    passage = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(90, 300))).decode() for _ in range(6)]
    line = "".join(rng.choice("xyz ") for _ in range(97))
    docs = {}
    for i in range(n):
        parts = [rng.choice(passage) if rng.random() < 0.4 else "".join(rng.choice("klmn é") for _ in range(rng.randrange(150))) for _ in range(4)]
        docs[i] = (line if i % 2 else "").join(parts)
        if i % 9 == 5:
            docs[i] = docs[i - 1][: rng.randrange(400)] + "!" + docs[i - 1][rng.randrange(50) :]
    return docs | {n: "q" * 500, n + 1: "", n + 2: "é" * 49, n + 3: "é" * 50, n + 4: "é" * 50}


@pytest.mark.parametrize("contexts, buffer, held", [(256, 1 << 21, 1 << 21), (1, 700, 100), (256, 700, 1)])
def test_report_matches_brute_force(spark, monkeypatch, contexts, buffer, held):
    monkeypatch.setattr(substring, "CONTEXTS", contexts)
    monkeypatch.setattr(substring, "BUFFER", buffer)
    monkeypatch.setattr(substring, "HELD", held)
    docs = made()
    frame = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(5)
    assert as_dict(substring.removal_report(frame).collect()) == plain_report({i: t.encode() for i, t in docs.items()})


def test_query(spark):
    from flightseal.llm.queries import op6_suffix_array

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert as_dict(op6_suffix_array(spark, SF).collect()) == plain_report(docs)


def test_odd_rows(spark):
    text = "word " * 30 + "é" * 80
    rows = [(1, None, 0), (2, "", 0), (3, text, 1), (3, text, 1), (None, text, 2), (5, text + "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in substring.removal_report(docs).collect())
    alone = plain_removed({0: text.encode()}, 100)[0]
    assert got == [(0, len(alone), sum(at - 1 not in alone for at in alone)), (1, 0, 0), (2, 0, 0), (3, len(text.encode()), 1), (3, len(text.encode()), 1), (5, len(text.encode()), 1)]
    kept = substring.remove_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect())[1:] == [(1, None), (2, ""), (5, "x")]
    assert substring.removal_report(docs.limit(0)).count() == 0


def test_unlike_rows_with_null_and_repeated_ids(spark):
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = make(150)
    rows = [(None, make(200) + passage), (None, make(300)), (None, passage + make(90)), (4, make(250)), (4, make(120) + passage + make(50)), (4, make(400)), (6, make(30) + passage)]
    rows += [rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    wanted = plain_report({k: t.encode() for k, (_, t) in enumerate(order)})
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring.removal_report(docs).collect()), key=str)
    assert got == sorted([(r[0], *wanted[order.index(r)]) for r in rows], key=str)
    gone = plain_removed({k: t.encode() for k, (_, t) in enumerate(order)}, 100)
    left = {r: "".join(c for at, c in enumerate(r[1]) if at not in gone[k]) for k, r in enumerate(order)}
    kept = sorted(((r.doc_id, r.text) for r in substring.remove_repeats(docs).collect()), key=str)
    assert kept == sorted([(r[0], left[r]) for r in rows if left[r]], key=str)


def test_columns_named_like_helpers(spark):
    same = "a passage of more than one hundred bytes that two documents share, so that the second one loses it as a whole; "
    docs = spark.createDataFrame([(1, same + "x", 5, "p", 1), (2, "y" + same, 6, "q", 2), (2, "z", 7, "r", 3)], "doc_id long, text string, id_ int, spans_ string, hash_ int")
    got = substring.remove_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, same + "x", 5, "p", 1), (2, "y", 6, "q", 2), (2, "z", 7, "r", 3)]
