"""Piece tables against plain string work, units against the pattern."""

import hashlib
import random
import re

import pytest

from flightseal.llm import fill_middle
from flightseal.llm.queries import op11_fill_middle
from tests.conftest import SF


def plain(doc_id, text, percent=90, spm=20, seed=1):
    text = text or ""
    units = re.findall("(?s)[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


ODD = [None, "", "a", " ", "\n\n", "abc", "é", "a<P>b", "<S", "<<S>>", "<M>", "< P>", "tail<", "<", "a1b2", "中文 字x", "word " * 40000, "é" * 70000, "." * 70001 + "ab"]


def rows_of(texts):
    return [(i if i % 7 else None, t, "x", 1, "y") for i, t in enumerate(texts)]


def test_against_strings(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab Z<>PSM\né中😀") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = rows_of(texts) + rows_of(texts)[3:6]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int, form string")
    for percent, spm in ((90, 20), (100, 50), (0, 0)):
        made = fill_middle.restore(fill_middle.transform(docs, percent, spm)).collect()
        wanted = sorted((str((r[0], *plain(r[0], r[1], percent, spm))) for r in rows))
        assert sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in made) == wanted
        assert sorted(r.text for r in made) == sorted(r[1] or "" for r in rows)
        for r in made:
            assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
            assert r.restored_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        if percent == 100:
            assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fill_middle.digest(docs.limit(0)).count() == 0


def test_restore_keeps_other_columns(spark):
    rows = [("<P>a<S>c<M>b", "psm", 1, "old"), ("<S>c<P>a<M>b", "spm", 2, "old"), (None, None, 3, None), ("x", "other", 4, None)]
    got = fill_middle.restore(spark.createDataFrame(rows, "output string, form string, own int, text string"))
    assert got.columns == ["output", "form", "own", "text", "restored_sha256"]
    assert [(r.own, r.text) for r in got.orderBy("own").collect()] == [(1, "abc"), (2, "abc"), (3, ""), (4, "x")]


def test_descriptors():
    table = fill_middle.PieceTable(b"abcdef").cut(0, 2, 2, 6)
    assert [bytes(x) for x in table.stream()] == [b"", b"ab", b"", b"cdef", b""]
    assert table.cut(1, 4).content() == b"abcdef" and len(table.cut(1, 4).descriptors) == 7
    order = [3, 0, 1, 4, 2]
    assert table.arranged(order).arranged(fill_middle.inverse(order)).descriptors == table.descriptors
    assert table.arranged(order).sha256() == hashlib.sha256(b"cdefab").hexdigest()


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_fill_middle(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        *found, output = plain(r.doc_id, docs[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == found
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


@pytest.mark.parametrize("text", [t for t in ODD if t])
def test_units(text):
    start, head = fill_middle.unit_starts(text.encode())
    assert int(start.sum()) == len(re.findall("(?s)[A-Za-z]+|[^A-Za-z]", text)) and int(head.sum()) == len(text)
