"""The permutation is one, files hold every sequence at its slot, reading resumes anywhere."""

import zlib

import numpy as np
import pytest

from flightseal.llm import tokens, training_order
from flightseal.llm.queries import op10_training_order
from tests.conftest import SF


@pytest.mark.parametrize("total", [1, 2, 3, 17, 1000, 4097])
def test_permutation(total):
    got = training_order.permuted(np.arange(total), total, 9)
    assert sorted(got.tolist()) == list(range(total))
    if total > 100:
        assert abs(np.corrcoef(got, np.arange(total))[0, 1]) < 0.2
        assert (got != training_order.permuted(np.arange(total), total, 10)).mean() > 0.9


def streams(docs):
    """{doc_id: ids with END}"""
    encoder = tokens.Encoder.of(tokens.vocabulary())
    return {i: np.append(np.frombuffer(x, "<u4"), 0).astype("<u2") for i, x in zip(docs, encoder.encode(list(docs.values())))}


def check(records, index, wanted, length, total):
    """records: {slot: bytes}; every document lies whole, in order, in the sequences of its task."""
    assert sorted(records) == list(range(total)) == sorted(r.slot for r in index)
    by = {r.slot: r for r in index}
    number = {int(s): i for i, s in enumerate(training_order.permuted(np.arange(total), total, 1234))}
    left, current = {i: list(x) for i, x in wanted.items()}, b""
    for slot in sorted(by, key=number.get):
        r = by[slot]
        data = records[slot][: 2 * r.n_tokens]
        assert zlib.crc32(data) == r.ids_crc32 and len(records[slot]) == 2 * length and not any(records[slot][2 * r.n_tokens :])
        own = np.frombuffer(data, "<u2")
        at = 0
        for doc in r.doc_ids:
            take = left[doc][0][: len(own) - at]
            assert (own[at : at + len(take)] == take).all()
            at += len(take)
            left[doc][0] = left[doc][0][len(take) :]
            if not len(left[doc][0]):
                left[doc].pop(0)
        assert at == len(own)
    assert not any(left.values())


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op10_training_order(spark, SF).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and all(r.read_back for r in got)
    assert {i for r in got for i in r.doc_ids} == set(docs)
    assert sum(r.n_tokens for r in got) == sum(map(len, streams(docs).values()))


@pytest.mark.parametrize("block, dealt", [(256, 8192), (2, 3)])
def test_files_and_resumed_reading(spark, tmp_path, monkeypatch, block, dealt):
    monkeypatch.setattr(training_order, "BLOCK", block)
    monkeypatch.setattr(training_order, "DEALT", dealt)
    rows = [(1, "some words here", 1), (1, "some words here", 1), (2, None, 2), (None, "x", 3), (3, "word " * 300, 4), (4, "", 4), (5, "a b c", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long").repartition(3)
    folder = f"file://{tmp_path}/out"
    index = training_order.write_training_order(docs, folder, length=16, shard_bytes=32 * 5).collect()
    total = len(index)
    assert len(list((tmp_path / "out").glob("shard-*.bin"))) == -(-total // 5)
    own = streams({i if i is not None else training_order.NULL_ID: t for i, t, _ in rows})
    wanted = {i: [x] * (2 if i == 1 else 1) for i, x in own.items()}
    for start in (0, 7, total - 1):
        read = training_order.read_training_order(spark, folder, total, start, 16, 32 * 5).collect()
        assert [r.slot for r in read] == list(range(start, total))
        if not start:
            check({r.slot: bytes(r.ids) for r in read}, index, wanted, 16, total)
    assert training_order.write_training_order(docs.limit(0), f"file://{tmp_path}/none").count() == 0
