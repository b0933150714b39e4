"""Fill-in-middle transformation on piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers
that never change: its text and the sentinels. Cutting splits a descriptor,
an arrangement permutes descriptors, the inverse permutation restores, and
hashes run over what the descriptors point at, so a text is copied only where
its output is wanted as a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts, tidy

# The sentinels, and the order in which each form has its parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PARTS = (PREFIX, SUFFIX, MIDDLE)
ARRANGED = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: The order of the parts in the document.
NATURAL = (PREFIX, MIDDLE, SUFFIX)

TEXT, SENTINELS = 0, 1
_SENTINELS = b"".join(PARTS)
_COUNTED = 1 << 16

Descriptor = tuple[int, int, int]


class PieceTable:
    """Descriptors over a text and the sentinels."""

    def __init__(self, text: bytes, descriptors: Sequence[Descriptor] | None = None):
        self.buffers = (memoryview(text), memoryview(_SENTINELS))
        self.descriptors = [(TEXT, 0, len(text))] if descriptors is None else list(descriptors)

    def cut(self, *places: int) -> PieceTable:
        """Splits descriptors at rising places (bytes of the whole); a place on an edge gives an empty descriptor before it."""
        out, at = [], 0
        for i, (buffer, start, length) in enumerate(self.descriptors):
            last = i == len(self.descriptors) - 1
            own = [p - at for p in places if at <= p and (last or p < at + length)]
            out += [(buffer, start + a, b - a) for a, b in zip([0, *own], [*own, length])]
            at += length
        return PieceTable(self.buffers[TEXT].obj, out)

    def arranged(self, order: Sequence[int]) -> PieceTable:
        """The descriptors in the given order; those it does not name go."""
        return PieceTable(self.buffers[TEXT].obj, [self.descriptors[i] for i in order])

    def with_sentinels(self, form: str) -> PieceTable:
        """Prefix, middle and suffix arranged for `form`, the sentinel of each before it."""
        out = []
        for part in ARRANGED[form]:
            out += [(SENTINELS, _SENTINELS.index(part), len(part)), self.descriptors[NATURAL.index(part)]]
        return PieceTable(self.buffers[TEXT].obj, out)

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.descriptors:
            yield self.buffers[buffer][start : start + length]

    def sha256(self) -> str:
        own = hashlib.sha256()
        for piece in self.stream():
            own.update(piece)
        return own.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.stream())


def inverse(order: Sequence[int]) -> list[int]:
    out = [0] * len(order)
    for i, j in enumerate(order):
        out[j] = i
    return out


def unit_starts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: whether a unit (a run of A-Z and a-z, or another code point) starts there, whether a code point does."""
    data = np.frombuffer(text, np.uint8)
    letter = ((data | 32) - np.uint8(97)) < 26
    head = (data & 0xC0) != 0x80
    start = head.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    return start, head


def _place(start: np.ndarray, counts: np.ndarray, unit: int) -> int:
    """Where the unit with this number starts; behind the last: the end."""
    block = int(np.searchsorted(counts, unit, side="right"))
    if block == len(counts):
        return len(start)
    before = int(counts[block - 1]) if block else 0
    low = block * _COUNTED
    return low + int(np.flatnonzero(start[low : low + _COUNTED])[unit - before])


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers decided by the id; a null id hashes as the word null."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def divided(text: bytes, doc_id: int | None, percent: int, spm_percent: int, seed: int) -> tuple:
    """(units, form, code points of the prefix, of the middle, piece table of the output)."""
    start, head = unit_starts(text)
    counts = np.cumsum(np.add.reduceat(start, np.arange(0, len(start), _COUNTED), dtype=np.int64)) if text else np.zeros(0, np.int64)
    n = int(counts[-1]) if text else 0
    h1, h2, h3, h4 = numbers(doc_id, seed)
    if not text or h3 % 100 >= percent or any(s in text for s in PARTS):
        return n, "plain", None, None, PieceTable(text)
    first, second = (_place(start, counts, x) for x in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    made = PieceTable(text).cut(first, second).with_sentinels(form)
    return n, form, int(np.count_nonzero(head[:first])), int(np.count_nonzero(head[first:second])), made


def undone(output: bytes, form: str | None) -> PieceTable:
    """The document as descriptors over the output: cut at its sentinels, put back by the inverse permutation.

    A document with a sentinel of its own stays plain, so every other output has each of them once.
    """
    if form not in ARRANGED:
        return PieceTable(output)
    places = []
    for part in ARRANGED[form]:
        at = output.index(part)
        places += [at, at + len(part)]
    cut = PieceTable(output).cut(*places)  # what is before the first sentinel is empty
    parts = cut.arranged([2, 4, 6])
    return parts.arranged(inverse([NATURAL.index(part) for part in ARRANGED[form]]))


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        for batch in batches:
            rows = [[] for _ in names]
            for made in make(batch):
                for column, value in zip(rows, made):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[f.split()[1]]) for x, f in zip(rows, schema.split(", "))], names=names)

    return df.mapInArrow(tidy(run), schema)


_MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def transform(docs: DataFrame, percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256), a row per document.

    `percent` of 100 documents get a form other than plain, `spm_percent` of 100
    of these spm; both are decided by seed and doc_id. A null text is empty, and
    an empty one or one that holds a sentinel stays plain. Rows with equal ids
    (or none) are cut at the same unit numbers; repeated rows give repeated
    rows, an empty table none. Other columns do not go along.
    """

    def make(batch):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            *found, table = divided(text or b"", doc_id, percent, spm_percent, seed)
            yield doc_id, *found, table.content(), table.sha256()

    return _mapped(texts(docs), make, _MADE)


def restore(rows: DataFrame) -> DataFrame:
    """Adds text and restored_sha256 to rows of `transform`, from their output and form alone.

    Needs the columns output and form; a null output is an empty one, a null or unknown
    form plain. Other columns go along, but for a text or restored_sha256 that is there.
    """
    rows = small_batches(rows.drop("text", "restored_sha256"))
    names = rows.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "text string, restored_sha256 string"])

    def run(batches):
        for batch in batches:
            tables = [undone(o or b"", f) for o, f in zip(batch.column("output").cast(pa.binary()).to_pylist(), batch.column("form").to_pylist())]
            added = [pa.array([t.content() for t in tables], pa.binary()).cast(pa.string()), pa.array([t.sha256() for t in tables])]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + added, names=[*names, "text", "restored_sha256"])

    return rows.mapInArrow(tidy(run), schema)


def digest(docs: DataFrame) -> DataFrame:
    """What `transform` and `restore` made of each document, without the texts."""
    made = restore(transform(docs))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: The same rows in DuckDB's SQL.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS hash,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents
), h AS (
  SELECT *, len(units) AS n, ('0x' || substr(hash, 1, 8))::BIGINT AS h1, ('0x' || substr(hash, 9, 8))::BIGINT AS h2,
         ('0x' || substr(hash, 17, 8))::BIGINT AS h3, ('0x' || substr(hash, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS prefix, coalesce(array_to_string(units[low + 1:high], ''), '') AS middle,
         coalesce(array_to_string(units[high + 1:], ''), '') AS suffix
  FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM p
), r AS (
  SELECT *, strpos(output, '<P>') AS at_p, strpos(output, '<S>') AS at_s, strpos(output, '<M>') AS at_m FROM o
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN substr(output, 4, at_s - 4) || substr(output, at_m + 3) || substr(output, at_s + 3, at_m - at_s - 3)
              ELSE substr(output, at_p + 3, at_m - at_p - 3) || substr(output, at_m + 3) || substr(output, 4, at_p - 4) END) AS restored_sha256
FROM r
"""
