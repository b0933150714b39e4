"""Removes passages that occur earlier in the corpus, as Spark jobs over `repeats`."""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import texts, tidy, unused
from .repeats import BUFFER, GRAM, LENGTH, Seen, merged, repeat_spans, runs

#: Occurrences that a task holds before it settles them among themselves and sends them on.
HELD = 1 << 18
#: An anchor with more contexts than this is settled window by window.
CONTEXTS = 256
NULL_ID = -(1 << 63)

_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_SENT_DDL = "bucket int, kind int, payload binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("key", pa.int64()), ("large", pa.bool_())])
_FOUND_DDL = "doc_id long, start long, stop long, key long, large boolean"
SPANS, OCCURRENCES, TEXTS = range(3)


def _pack(x) -> bytes:
    return zlib.compress(pickle.dumps(x, protocol=5), 1)


def _unpack(x: bytes):
    return pickle.loads(zlib.decompress(x))


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _found(doc, start, stop, key=None, large=None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(doc), 1 << 16):
        cut = slice(at, at + (1 << 16))
        n = len(doc[cut])
        yield pa.RecordBatch.from_arrays([
            pa.array(doc[cut], pa.int64()), pa.array(np.asarray(start[cut], np.int64)), pa.array(np.asarray(stop[cut], np.int64)),
            pa.nulls(n, pa.int64()) if key is None else pa.array(key[cut].view(np.int64)),
            pa.nulls(n, pa.bool_()) if large is None else pa.array(large[cut]),
        ], schema=_FOUND)


def _sent(seen: Seen, buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """First occurrences by bucket of their key; the later ones are repeats already."""
    first, later = seen.settle()
    rows = []
    if len(later):
        spans = merged(later.doc, later.start, later.start.astype(np.int64) + later.count + (length - 1))
        rows.append((int(xxhash.xxh32_intdigest(spans[0].tobytes()) % buckets), SPANS, _pack(spans)))
    bucket = (first.key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.unique(bucket).tolist():
        rows.append((b, OCCURRENCES, _pack(first.take(order[cuts[b] : cuts[b + 1]]).arrays)))
    if rows:
        yield _rows(_SENT, rows)


def _pieces(ids, texts, length: int):
    """(doc, place of the piece in it, bytes): whole texts, the longest cut with an overlap of a window."""
    for i, text in zip(ids, texts):
        data = (text or "").encode()
        for at in range(0, max(1, len(data) - length + 1), BUFFER):
            yield i, at, data[at : at + BUFFER + length - 1]


def _occurrences(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> Seen:
    data = b"".join(p[2] for p in pieces)
    ends = np.cumsum([len(p[2]) for p in pieces])
    key, _, start, count = runs(data, ends, length, gram)
    stops = (start + count + (length - 1)).tolist()
    digest = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), stops)]
    piece = np.searchsorted(ends, start, side="right")
    shift = np.array([at - (end - len(d)) for (_, at, d), end in zip(pieces, ends.tolist())], np.int64)
    return Seen(key, np.array(digest, np.uint64), np.array([p[0] for p in pieces], np.int64)[piece], start + shift[piece], count)


def _scan(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    def run(batches):
        held, size, pieces, filled = [], 0, [], 0

        def close():
            nonlocal pieces, filled, size
            if pieces:
                held.append(_occurrences(pieces, length, gram))
                size += len(held[-1])
            pieces, filled = [], 0

        for batch in batches:
            for piece in _pieces(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), length):
                if filled + len(piece[2]) > BUFFER + length:
                    close()
                if len(piece[2]) >= length:
                    pieces.append(piece)
                    filled += len(piece[2])
                if size > HELD:
                    yield from _sent(Seen.join(held), buckets, length)
                    held, size = [], 0
        close()
        yield from _sent(Seen.join(held), buckets, length)

    return texts(docs).mapInArrow(tidy(run), _SENT_DDL)


def _settled(sent: DataFrame, buckets: int, length: int) -> DataFrame:
    """Repeats among equal contexts, and (with a key) the contexts whose bytes are still to be compared."""

    def run(batches):
        seen, bytes_ = [], []
        for batch in batches:
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist()):
                what = _unpack(payload)
                if kind == SPANS:
                    yield from _found(*what)
                elif kind == TEXTS:
                    bytes_.append(what)
                else:
                    seen.append(Seen(*what))
        first, later = Seen.join(seen).settle()
        yield from _found(*merged(later.doc, later.start, later.start.astype(np.int64) + later.count + (length - 1)))
        if bytes_:
            key, doc, start, count = (np.concatenate(x) for x in list(zip(*bytes_))[:4])
            yield from _found(*repeat_spans(key, doc, start, count, [t for part in bytes_ for t in part[4]], length))
        elif len(first):
            _, group, sizes = np.unique(first.key, return_inverse=True, return_counts=True)
            open_ = first.take(sizes[group] > 1)
            large = sizes[group][sizes[group] > 1] > CONTEXTS
            yield from _found(open_.doc, open_.start, open_.start.astype(np.int64) + open_.count, open_.key, large)

    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(run), _FOUND_DDL)


def _contexts(docs: DataFrame, open_: DataFrame, buckets: int, length: int) -> DataFrame:
    """The bytes of the open contexts by key; those of large keys as single windows by their hashes."""
    wanted = open_.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "key", "large")).alias("open"))

    def run(batches):
        def windows(held):
            return Seen.join(Seen(k, g, np.full(len(k), d), s, np.ones(len(k))) for d, k, g, s in held)

        parts, held, size = [], [], 0

        def send():
            if held:
                yield from _sent(windows(held), buckets, length)
            if parts:
                key, doc, start, count, data = zip(*parts)
                key = np.array(key, np.int64).view(np.uint64)
                bucket = key % np.uint64(buckets)
                rows = []
                for b in np.unique(bucket).tolist():
                    at = np.nonzero(bucket == b)[0]
                    part = [np.array(x)[at] for x in (doc, start, count)]
                    rows.append((int(b), TEXTS, _pack((key[at], *part, [data[i] for i in at]))))
                yield _rows(_SENT, rows)

        for batch in batches:
            for doc, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "open"))):
                data = (text or "").encode()
                for x in asked:
                    start, stop = x["start"], x["stop"]
                    part = data[start : stop + length - 1]
                    if not x["large"]:
                        parts.append((x["key"], doc, start, stop - start, part))
                    else:
                        own = [part[i : i + length] for i in range(stop - start)]
                        digest = np.array([xxhash.xxh3_128_digest(w) for w in own])
                        pair = np.frombuffer(b"".join(d.ljust(16, b"\0") for d in digest.tolist()), np.uint64).reshape(-1, 2)
                        held.append((doc, pair[:, 0], pair[:, 1], np.arange(start, stop)))
                    size += stop - start
                if size > HELD:
                    yield from send()
                    parts, held, size = [], [], 0
        yield from send()

    return docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "open").mapInArrow(tidy(run), _SENT_DDL)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, stop) byte spans of windows of `length` that also start earlier in the corpus.

    Earlier: a smaller doc_id, or the same and a smaller start. Null texts are
    empty, null ids the smallest. Rows that share a doc_id must share their text
    too (see `_numbered`): they get the same spans. Every occurrence is compared; a task
    sends one row per distinct context, so a passage in a third of all texts
    costs its anchor one row per task.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    found = materialize(_settled(_scan(docs, buckets, length, gram), buckets, length), "repeats-found")
    open_ = found.where("key is not null")
    rest = materialize(_settled(_contexts(docs, open_, buckets, length), buckets, length), "repeats-rest")
    return found.where("key is null").unionByName(rest.where("key is null")).select("doc_id", "start", "stop")


def _numbered(docs: DataFrame, id_: str) -> DataFrame:
    """Adds id_: a long per document, which is a doc_id with a text.

    The doc_id itself (null the smallest), or, where unlike texts share one, a
    number that rises with doc_id, then text hash.
    """
    hash_, number_ = unused([*docs.columns, id_], "hash", "number")
    own = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    keyed = own.withColumn(hash_, F.coalesce(F.md5("text"), F.lit("")))
    pairs = materialize(keyed.select(id_, hash_), "repeats-pairs")
    if not pairs.groupBy(id_).agg(F.min(hash_).alias("a"), F.max(hash_).alias("b")).where("a <> b").head(1):
        return own
    ordered = pairs.distinct().sort(id_, hash_)
    numbers = materialize(ordered.withColumn(number_, F.monotonically_increasing_id()), "repeats-numbers")
    return keyed.join(numbers, [id_, hash_]).drop(id_, hash_).withColumnRenamed(number_, id_)


def _with_spans(docs: DataFrame, length: int, spans_: str) -> DataFrame:
    """Adds spans_: the packed spans of the row's document, null where nothing repeats."""
    (id_,) = unused([*docs.columns, spans_], "id")
    own = _numbered(docs, id_)
    packed = F.shiftleft("start", 32).bitwiseOR(F.col("stop"))
    spans = repeats(own.select(F.col(id_).alias("doc_id"), "text"), length)
    spans = spans.groupBy("doc_id").agg(F.collect_list(packed).alias(spans_)).withColumnRenamed("doc_id", id_)
    return own.join(spans, id_, "left").drop(id_)


def _cut(data: bytes, packed: list[int] | None) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, removed runs)."""
    if not packed:
        return data, 0, 0
    spans = np.array(packed, np.int64)
    _, start, stop = merged(np.zeros(len(spans), np.int64), spans >> 32, np.minimum(spans & 0xFFFFFFFF, len(data)))
    at = [0, *stop.tolist()]
    return b"".join(data[a:b] for a, b in zip(at, [*start.tolist(), len(data)])), int((stop - start).sum()), len(start)


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans_"))):
                data = (text or "").encode()
                kept, removed, n = _cut(data, spans)
                rows.append((doc, len(data), removed, n, hashlib.sha256(kept).hexdigest()))
            if rows:
                yield _rows(schema, rows)

    slim = _with_spans(texts(docs), length, "spans_")
    return slim.select("doc_id", "text", "spans_").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows with repeated passages taken out of `text` (and n_chars, where there is one, counted anew).

    A character that a span cuts through goes as a whole. Rows of which nothing
    is left go; texts that were null or empty stay. An empty table stays empty.
    """
    (spans_,) = unused(docs.columns, "spans")
    with_spans = _with_spans(docs, length, spans_)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts, keep = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(spans_).to_pylist()):
                if spans:
                    text = _cut(text.encode(), spans)[0].decode("utf-8", "ignore")
                texts.append(text)
                keep.append(not spans or text != "")
            out = batch.drop_columns([spans_])
            out = out.set_column(out.schema.get_field_index("text"), out.schema.field("text"), pa.array(texts, pa.string()))
            if "n_chars" in out.schema.names:
                at = out.schema.get_field_index("n_chars")
                counts = [n if not s else len(t) for n, s, t in zip(out.column(at).to_pylist(), batch.column(spans_).to_pylist(), texts)]
                out = out.set_column(at, out.schema.field(at), pa.array(counts, out.schema.field(at).type))
            yield out.filter(pa.array(keep, pa.bool_()))

    return with_spans.select(*docs.columns, spans_).mapInArrow(tidy(run), schema)
