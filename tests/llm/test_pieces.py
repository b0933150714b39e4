"""Ids by distinct chunks against the library on whole texts."""

import hashlib
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from flightseal.llm import pieces, tokens
from flightseal.llm.queries import op13_sentencepiece
from tests.conftest import SF


@pytest.fixture(scope="module")
def sp():
    return pieces.processor(pieces.vocabulary())


ODD = [None, "", " ", "  ", "a", " a", "a ", "  a  b   ", "\n", "a\n b\t\tc", "▁", "▁a▁ ▁b", "<s> </s> <unk>", "<0x0A>", "x\x00y", "é中文字한국어 😀‍👩", " 　x", " " * 5000, "w" * 30000, "many words " * 20000]


def test_cut_keeps_the_text():
    for text in ODD:
        chunks = pieces.cut(text or "", True)
        assert "".join(chunks) == ("▁" + text.replace(" ", "▁") if text else "")
        assert all(c.startswith("▁") and "▁" not in c.lstrip("▁") for c in chunks)


@pytest.mark.parametrize("block_bytes, apart", [(1 << 24, True), (40, True), (1000, False)])
def test_odd_rows(spark, sp, monkeypatch, block_bytes, apart):
    monkeypatch.setattr(pieces, "chunked", lambda path: apart)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab  ▁é\n中1") for _ in range(rng.randrange(50))) for _ in range(200)] + ["same words"] * 30
    rows = [(i if i % 6 else None, t, 1, 2, [3]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, code int, ids array<int>").repartition(3)
    for end in (True, False):
        got = pieces.decode(pieces.encode(docs, end=end, block_bytes=block_bytes)).collect()
        wanted = [(r[0], sp.encode(r[1] or "", add_eos=end)) for r in rows]
        assert sorted(str((r.doc_id, list(r.ids), r.n_tokens, r.decoded)) for r in got) == sorted(str((i, x, len(x), sp.decode(x))) for i, x in wanted)
    assert pieces.digest(docs.limit(0)).count() == 0


def test_chunks_are_segmented_once(sp, monkeypatch):
    """A block asks for its distinct chunks, and for none that an earlier block of the worker had."""
    asked, segment = [], pieces.segment

    def counted(chunks, sp):
        asked.extend(chunks)
        return segment(chunks, sp)

    monkeypatch.setattr(pieces, "segment", counted)
    cache = tokens.Recent(1000)
    for texts in (["a b a", "b c"], ["c d a", "d"]):
        table = pieces.ChunkTable()
        places = [table.positions(pieces.cut(t, True)) for t in texts]
        table.segmented(cache, sp)
        assert [table.joined(p).tolist() for p in places] == [sp.encode(t) for t in texts]
    assert sorted(asked) == ["▁a", "▁b", "▁c", "▁d"]


def test_cache_of_two_generations(sp, monkeypatch):
    """A full cache still serves the generation before; what aged out and long chunks are segmented again, and the ids stay right."""
    asked, segment = [], pieces.segment

    def counted(chunks, sp):
        asked.append(sorted(chunks))
        return segment(chunks, sp)

    monkeypatch.setattr(pieces, "segment", counted)
    cache, long = tokens.Recent(2), "w" * (tokens.LONGEST + 1)
    for text in (f"a b c {long}", "a d", f"b {long}", "e", "c a"):
        table = pieces.ChunkTable()
        places = table.positions(pieces.cut(text, True))
        table.segmented(cache, sp)
        assert table.joined(places).tolist() == sp.encode(text)
    again = f"▁{long}"
    assert asked == [["▁a", "▁b", "▁c", again], ["▁d"], [again], ["▁e"], ["▁c"]]
    assert again not in cache and again not in cache.older


def test_texts_are_cut_together():
    """Chunks of an array of texts are those of each text, also where markers meet at a text's end."""
    texts = [t or "" for t in ODD] + ["a ", " b", "▁", "▁", "", "c"]
    for apart in (True, False):
        chunks, ends = pieces.cut_texts(pa.array(["dropped", *texts], pa.large_string())[1:], apart)
        chunks, bounds = chunks.to_pylist(), [0, *ends.tolist()]
        wanted = [re.findall("▁+[^▁]*", f"▁{t}".replace(" ", "▁")) if apart else [f"▁{t}"] for t in texts]
        assert [chunks[a:b] for a, b in zip(bounds, bounds[1:])] == [w if t else [] for t, w in zip(texts, wanted)]
        assert len(chunks) == bounds[-1]


def test_blocks_keep_all_rows():
    """Blocks hold at most so many bytes or one document, and all rows in their order."""
    texts = [None, "é" * 30, "", "a" * 10, "b" * 25, "", "c" * 5, None, "d" * 100, "e" * 41, "", "f"]
    rows = pa.table({"doc_id": pa.array([None, *range(1, len(texts))], pa.int64()), "text": pa.array(texts, pa.string())})
    for size in (1, 2, 5, 100):
        blocks = [(n.to_pylist(), b.to_pylist()) for n, b in pieces._blocks(rows.to_batches(max_chunksize=size), 40)]
        assert [x for n, _ in blocks for x in n] == rows["doc_id"].to_pylist()
        assert [x for _, b in blocks for x in b] == [t or "" for t in texts]
        assert all(sum(len(t.encode()) for t in b) <= 40 or sum(t != "" for t in b) == 1 for _, b in blocks)


def test_only_odd_lists_ask_the_library(sp, monkeypatch):
    """Texts are joined from spellings; the library decodes the lists that hold more than that, each once."""
    asked, rng = [], random.Random(3)
    known = range(sp.vocab_size())
    parts = [i for i in known if sp.is_byte(i) and int(sp.id_to_piece(i)[1:-1], 16) in (32, *range(128, 256))]
    plain = [i for i in known if i not in parts and not sp.is_unknown(i)]
    fronts = [i for i in plain if sp.id_to_piece(i).startswith("▁")] + [i for i in known if sp.is_control(i)]
    lists = [None, [], [sp.piece_to_id("▁")], *(sp.encode(t or "", add_bos=True, add_eos=True) for t in ODD)]
    lists += [rng.choices(fronts, k=rng.randrange(4)) + rng.choices(plain, k=rng.randrange(30)) for _ in range(500)]
    odd = [[i, *rng.choices(plain, k=5)] for i in (sp.unk_id(), *parts)] + [rng.choices(known, k=9) + [sp.unk_id()] for _ in range(100)]
    real, holds = sp.decode, lambda ids: bool({sp.unk_id(), *parts} & set(ids or []))
    names = ("vocab_size", "id_to_piece", "is_byte", "is_unknown", "is_control")
    counting = SimpleNamespace(**{n: getattr(sp, n) for n in names}, decode=lambda ids: asked.append(ids) or real(ids))
    rows = [x for pair in zip(odd, lists) for x in pair] + lists + odd
    monkeypatch.setattr(pieces, "SPELLED", 64)
    got = pieces.Speller(counting, True).texts(pa.array([[1], *rows], pa.list_(pa.int32()))[1:])
    assert got.to_pylist() == [real(x or []) for x in rows] and asked == [x for x in rows if holds(x)]
    assert pieces.Speller(sp, False).texts(pa.array(rows[:50], pa.list_(pa.int32()))).to_pylist() == got.to_pylist()[:50]
    assert pieces.Speller(sp, True).texts(pa.array([], pa.list_(pa.int32()))).to_pylist() == []
    for ids in ([-1], [sp.vocab_size()]):
        with pytest.raises(IndexError):
            pieces.Speller(sp, True).texts(pa.array([ids], pa.list_(pa.int32())))


def test_ids_are_placed_in_runs(sp, monkeypatch):
    monkeypatch.setattr(pieces, "PLACED", 3)
    texts = ["a b  c a b d", "", " b", "é\n a"]
    table = pieces.ChunkTable()
    chunks, ends = pieces.cut_texts(pa.array(texts, pa.large_string()), True)
    places = table.positions(chunks)
    table.segmented(tokens.Recent(10), sp)
    ids = np.split(table.joined(places), table.ends(places)[ends][:-1])
    assert [x.tolist() for x in ids] == [sp.encode(t) for t in texts]


def test_only_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.doc_id, list(r.ids)) for r in pieces.encode(docs).orderBy("doc_id").collect()] == [(1, [2]), (2, [2])]


def test_decode_keeps_other_columns(spark, sp):
    rows = spark.createDataFrame([(1, sp.encode("a  b"), "old"), (2, None, "old"), (3, [], None)], "own int, ids array<int>, decoded string")
    got = pieces.decode(rows)
    assert got.columns == ["own", "ids", "decoded"]
    assert [r.decoded for r in got.orderBy("own").collect()] == ["a  b", "", ""]


def test_query(spark, sp):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op13_sentencepiece(spark, SF).collect()
    assert len(got) == len(docs)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for r in got:
        ids = sp.encode(docs[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
