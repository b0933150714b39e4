"""SentencePiece encoding by tables of distinct chunks, and decoding.

Where no piece of the vocabulary has a whitespace marker behind another
character, merges never cross the place before a marker. So a text is the ids
of its chunks (markers and the word behind them), one after the other. A task
cuts its texts into blocks; a block is a table of its distinct chunks and
positions that point into it. Each chunk of the table is segmented once, those
that the worker met in earlier blocks not again, and the ids are joined back by
position. Blocks share nothing but that bounded cache, so nothing is shuffled.
Arrow cuts and numbers the chunks of a block, and joins the spellings of pieces
to decoded texts, so that Python sees a block's distinct chunks only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches, texts, tidy
from .tokens import Recent

#: Bytes of text in a block, and chunks that a Python worker keeps in each of two generations.
BLOCK_BYTES, CHUNKS = 1 << 22, 200_000
#: Chunks whose ids are put in place at once, and ids that are decoded at once (one text's at least).
PLACED, SPELLED = 1 << 16, 1 << 18
MARK = "▁"
_MARK, _LARGE = MARK.encode(), pa.large_string()
_CROSSING = re.compile(f"[^{MARK}]{MARK}")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def processor(path: str):
    """The worker's processor of this model."""
    made = kept(__name__)
    if path not in made:
        import sentencepiece

        made[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return made[path]


def _model(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return model


def chunked(path: str) -> bool:
    """Whether texts of this model can be cut before whitespace markers."""
    model = _model(path)
    rules, plain = model.normalizer_spec, {1, 4, 5}  # ordinary, user-defined, unused
    pieces = [p.piece for p in model.pieces if p.type in plain]
    unchanged = not rules.precompiled_charsmap and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    fitting = rules.add_dummy_prefix and not model.trainer_spec.treat_whitespace_as_suffix and MARK in pieces
    return bool(unchanged and fitting and not any(_CROSSING.search(p) for p in pieces))


def spelled(path: str) -> bool:
    """Whether a decoded text is the spellings of its pieces, one after the other, without the first marker."""
    model = _model(path)
    rules, suffix = model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix
    return bool(rules.add_dummy_prefix and not rules.remove_extra_whitespaces and not suffix and not model.denormalizer_spec.precompiled_charsmap)


def cut_texts(texts: pa.Array, apart: bool) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts (large strings, none null), each with at least one marker before it, and where each
    text's end. An empty text has none. Not `apart`: a whole text is one."""
    filled = pc.binary_length(texts).to_numpy() > 0
    marked = pc.binary_join_element_wise(pa.scalar(MARK, _LARGE), texts.filter(pa.array(filled)), pa.scalar("", _LARGE))
    if not apart or not len(marked):
        return marked, np.cumsum(filled)
    marked = pc.replace_substring(marked, " ", MARK)
    _, offsets, data = marked.buffers()
    bounds, own = np.frombuffer(offsets, np.int64)[: len(marked) + 1], np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(own[: bounds[-1]] == _MARK[0])
    marks = marks[(own[marks + 1] == _MARK[1]) & (own[marks + 2] == _MARK[2])]
    first = np.append(True, np.diff(marks) != len(_MARK))
    first[np.searchsorted(marks, bounds[:-1])] = True  # a text ends where the next begins, whatever markers meet there
    starts = np.append(marks[first], bounds[-1])
    chunks = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data)
    ends = np.searchsorted(starts, bounds)
    return chunks, ends[np.append(0, np.cumsum(filled))][1:]


def cut(text: str, apart: bool) -> list[str]:
    """The chunks of a text."""
    return cut_texts(pa.array([text], _LARGE), apart)[0].to_pylist()


def segment(chunks: list[str], sp) -> list[bytes]:
    """Ids of each chunk (little-endian, 32 bits); the processor itself puts the first marker there."""
    mark = [sp.piece_to_id(MARK)]
    found = [mark if c == MARK else ids for c, ids in zip(chunks, sp.encode([c[1:] for c in chunks], num_threads=1))]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    data = np.fromiter(chain.from_iterable(found), "<i4", ends[-1] if len(ends) else 0).tobytes()
    ends = (4 * ends).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _strings(array: pa.Array) -> list[str]:
    """The large strings of `array`, by one split where none of them holds a space."""
    if not len(array):
        return []
    lines = pc.binary_join_element_wise(array, pa.scalar("", _LARGE), pa.scalar(" ", _LARGE))
    found = str(lines.buffers()[2], "utf8").split(" ")[:-1]
    return found if len(found) == len(array) else array.to_pylist()


def _blocks(batches, block_bytes: int):
    """(doc_ids, texts) of at most so many bytes each; a longer document is a block of its own. A null text is empty."""
    names, bodies, held = [], [], 0
    for batch in batches:
        ids, text = batch.column("doc_id"), batch.column("text").cast(_LARGE).fill_null("")
        total, low = np.cumsum(pc.binary_length(text).to_numpy(), dtype=np.int64), 0
        while low < len(text):
            before = total[low - 1] if low else 0
            high = int(np.searchsorted(total, block_bytes - held + before, side="right"))
            if high <= low and not names:
                high = low + 1
            if high > low:
                names.append(ids[low:high])
                bodies.append(text[low:high])
                held += int(total[high - 1] - before)
            if high < len(text):
                yield pa.concat_arrays(names), pa.concat_arrays(bodies)
                names, bodies, held = [], [], 0
            low = max(low, high)
    if names:
        yield pa.concat_arrays(names), pa.concat_arrays(bodies)


class ChunkTable:
    """Distinct chunks in the order in which they were met, and the ids of each."""

    def __init__(self):
        self.rows: list[str] = []

    def positions(self, chunks: pa.Array | Sequence[str]) -> np.ndarray:
        """The row of each chunk; the distinct ones are added, so the chunks of a block should come in one call."""
        coded = (chunks if isinstance(chunks, pa.Array) else pa.array(chunks, _LARGE)).dictionary_encode()
        before = len(self.rows)
        self.rows += _strings(coded.dictionary)
        return coded.indices.to_numpy() + before

    def segmented(self, cache: Recent, sp) -> None:
        """Ids of all rows, one after the other, and where each row's ids start; only chunks that `cache` lacks are segmented."""
        cache.turn()
        found = list(map(cache.get, self.rows))
        places = [j for j, x in enumerate(found) if x is None]
        asked = [self.rows[j] for j in places]
        new = list(dict.fromkeys(c for c, ids in zip(asked, cache.recalled(asked)) if ids is None))
        cache.update(zip(new, segment(new, sp)))
        for j, ids in zip(places, map(cache.__getitem__, asked)):
            found[j] = ids
        cache.forget_long(new)
        self.sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.frombuffer(b"".join(found), "<i4")

    def ends(self, positions: np.ndarray) -> np.ndarray:
        """How many ids the rows at the first 0, 1, 2 ... of these positions have."""
        return np.append(0, np.cumsum(self.sizes[positions]))

    def joined(self, positions: np.ndarray) -> np.ndarray:
        """The ids of the rows at these positions, one row's after the other's."""
        ends = self.ends(positions)
        out = np.empty(ends[-1], np.int32)
        for low in range(0, len(positions), PLACED):
            which, bounds = positions[low : low + PLACED], ends[low : low + PLACED + 1]
            places = np.repeat(self.starts[which] - bounds[:-1], np.diff(bounds))
            out[bounds[0] : bounds[-1]] = self.ids[places + np.arange(bounds[0], bounds[-1])]
        return out


def encode(docs: DataFrame, path: str | None = None, end: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>), a row per document, as the library encodes the whole text; end: its end id last.

    A null or empty text has no ids but the end. Repeated rows give repeated
    rows, null ids stay null, an empty table gives none; other columns do not go
    along. For a model whose pieces can cross a marker every text is one chunk.
    """
    path = path or vocabulary()
    apart, tail = chunked(path), [processor(path).eos_id()] if end else []

    def run(batches):
        sp, cache = processor(path), kept(__name__).setdefault(("chunks", path), Recent(CHUNKS))
        for names, bodies in _blocks(batches, block_bytes):
            table = ChunkTable()
            chunks, ends = cut_texts(bodies, apart)
            positions = table.positions(chunks)
            table.segmented(cache, sp)
            ids, ends = table.joined(positions), table.ends(positions)[ends]
            if tail:
                ids, ends = np.insert(ids, ends, tail[0]), ends + np.arange(1, len(ends) + 1)
            lengths = np.diff(ends, prepend=0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([names, pa.array(lengths, pa.int64()), lists], names=["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids array<int>")


class Speller:
    """The library's texts of lists of ids, from a table of what each piece is in a text.

    Ids that are more than their spelling (unknown, parts of a character, a
    space as a byte, out of range) are left to the library, with all their list.
    """

    def __init__(self, sp, joins: bool):
        self.sp, known = sp, range(sp.vocab_size())
        code = [int(sp.id_to_piece(i)[1:-1], 16) if sp.is_byte(i) else -1 for i in known]
        self.plain = np.array([joins and not sp.is_unknown(i) and c < 128 and c != 32 for i, c in zip(known, code)])
        text = ["" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ") if c < 0 else chr(c) for i, c in zip(known, code)]
        self.text = pa.array([t if p else "" for t, p in zip(text, self.plain)], pa.string())

    @classmethod
    def of(cls, path: str, joins: bool) -> Speller:
        """The worker's speller of this model."""
        made, key = kept(__name__), ("speller", path, joins)
        if key not in made:
            made[key] = cls(processor(path), joins)
        return made[key]

    def texts(self, lists: pa.Array) -> pa.Array:
        """The text of each list; null: empty."""
        sizes, ids = pc.list_value_length(lists).fill_null(0).to_numpy(), lists.flatten()
        if ids.null_count:
            raise ValueError("an id is null")
        ids, ends, made, low = ids.to_numpy(), np.append(0, np.cumsum(sizes, dtype=np.int64)), [], 0
        while low < len(sizes):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + SPELLED, side="right")) - 1)
            made.append(self._run(ids[ends[low] : ends[high]], ends[low : high + 1] - ends[low]))
            low = high
        return pa.concat_arrays(made) if made else pa.array([], pa.string())

    def _run(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        safe = (ids >= 0) & (ids < len(self.plain))
        safe[safe] = self.plain[ids[safe]]
        odd = np.diff(np.append(0, np.cumsum(~safe))[ends]) > 0
        spelt = self.text.take(pa.array(np.where(safe, ids, 0)))
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spelt), "")
        out = pc.replace_substring_regex(out, r"\A ", "", max_replacements=1)
        if odd.any():
            rest = [self.sp.decode(ids[ends[i] : ends[i + 1]].tolist()) for i in np.flatnonzero(odd)]
            out = pc.replace_with_mask(out, pa.array(odd), pa.array(rest, pa.string()))
        return out


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Adds decoded, the library's text of `ids` (array<int>; null: none), to rows; a column of that name is replaced."""
    path = path or vocabulary()
    rows, joins = small_batches(rows.drop("decoded")), spelled(path)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "decoded string"])

    def run(batches):
        speller = Speller.of(path, joins)
        for batch in batches:
            made = speller.texts(batch.column(batch.schema.get_field_index("ids")))
            yield batch.append_column("decoded", made)

    return rows.mapInArrow(tidy(run), schema)


def digest(docs: DataFrame) -> DataFrame:
    """Counts and hashes of each document's ids and of what they decode to."""
    both = decode(encode(docs))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", "n_tokens", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
