"""Token ids against the tokenizer, packing against its bounds."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from flightseal.llm import packing, tokens
from flightseal.llm.queries import op5_packing
from flightseal.session import materialize
from tests.conftest import SF


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = ["", None, "a", "don't WON'T it's 's", "x y z", "a\x1cb \x85c", "é ́e", "İSTANBUL ΣΑΣ ΑΣ.", "ß 中文字 한국어 가", "1234 5,6", "<|endoftext|>x<|startoftext|> y", "!!??..\n\r\t\v\f z", "​﻿ a b", "w" * 3000]


def test_ids_match_the_tokenizer(plain, monkeypatch):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("aé'sN 1!́ \x1c　ǅ") for _ in range(60)) for _ in range(300)]
    for cached in (60_000, 20):
        monkeypatch.setattr(tokens, "WORDS", cached)
        monkeypatch.setattr(tokens, "PARTS", cached)
        got = tokens.Encoder(tokens.vocabulary()).encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(t) for t in texts]


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_query(spark, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op5_packing(spark, SF).collect()
    wanted = set()
    for i, text in docs.items():
        ids = plain(text) + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            wanted.add((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert {tuple(r[:5]) for r in got} == wanted and len(got) == len(wanted)
    assert check(got, 2048) <= -(-sum(r.length for r in got) // 2048) + 2


def optimal(lengths, capacity):
    """Fewest bins by search over all partitions."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best and i < len(lengths) or len(bins) > best:
            return
        if i == len(lengths):
            best = min(best, len(bins))
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                bins[b] += lengths[i]
                place(i + 1, bins)
                bins[b] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_genetic_steps_keep_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = {int(x): int(rng.integers(1, 40)) for x in rng.integers(1, 101, 30)}
        one = packing.best_fit(counts, 100, {}, packing._noisy(counts, rng, 0.5))
        other = packing.best_fit(counts, 100, {}, sorted(counts, reverse=True))
        child = packing.mutate(packing.crossover(one, other, counts, 100, rng), 100, rng)
        for bins in (one, other, child):
            assert packing.contents(bins) == Counter(counts) and all(sum(p) <= 100 for p in bins)


def test_small_cases_are_optimal():
    rng = random.Random(2)
    for seed in range(15):
        lengths = sorted((rng.randrange(2, 11) for _ in range(9)), reverse=True)
        best = packing.evolve(dict(Counter(lengths)), 10, [], seed, 20, 8)
        assert sum(best.values()) == optimal(lengths, 10)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 5), (2, "word " * 5000, 5)], "doc_id long, text string, length int")
    got = packing.pack_documents(docs).collect()
    assert check(got, 2048) == 3 and sorted(r.length for r in got) == [1, 1, 1, 905, 2048, 2048]
    assert packing.pack_documents(docs.limit(0)).count() == 0
    with_ids = packing.pack_documents(docs, ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in with_ids)


def test_columns_named_like_helpers(spark):
    pieces = materialize(spark.createDataFrame([(i, 0, 1 + i % 7, i, i) for i in range(60)], "doc_id long, piece int, length long, rank_ long, own_ long"), "test-pieces")
    got = packing.pack(pieces, 16)
    rows = got.collect()
    assert got.columns == [*pieces.columns, "sequence_id", "offset"] and all(r.rank_ == r.own_ == r.doc_id for r in rows)
    check(rows, 16)
