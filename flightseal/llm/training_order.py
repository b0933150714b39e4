"""Token sequences written in training order.

A keyed Feistel network permutes 0 .. 2**(2h) - 1; walking its cycles from a
number below N until it is below N again permutes 0 .. N - 1. So every sequence
has a global slot that anybody computes from its number and the key. Slots are
dealt by range to shards; a shard file holds its slots one after the other, each
`length` ids wide, so slot s lies at byte (s mod per_shard) * stride of shard
s div per_shard and reading can go on from any slot.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from . import tokens
from .common import texts
from .files import opened, write_whole

LENGTH = 512
SHARD_BYTES = 1 << 24
ROUNDS = 6
#: Sequences in a row of the written table, and those that a task gathers before it sends them to their shards.
BLOCK, DEALT = 256, 1 << 13
NULL_ID = -(1 << 63)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """Where a permutation of 0 .. total - 1 puts the numbers."""
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [(key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64) for r in range(ROUNDS)]
    out = np.asarray(numbers).astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        x = (left << np.uint64(half)) | right
        out[walk] = x
        walk = walk[x >= np.uint64(total)]
    return out.astype(np.int64)


def _squeezed(x) -> bytes:
    return zstandard.ZstdCompressor(3).compress(pickle.dumps(x, protocol=5))


def _opened(x: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def _narrow(ids: np.ndarray) -> np.ndarray:
    """Ids of 32 bits as those of 16 bits that the shards hold; a larger id is an error."""
    if len(ids) and ids.max() > 0xFFFF:
        raise ValueError(f"id {ids.max()} does not fit a shard of 16-bit ids")
    return ids.astype("<u2")


def sequences(docs: DataFrame, length: int, path: str) -> DataFrame:
    """(part, first, rows, block): BLOCK sequences a row. A task joins the ids of its documents, END after each,
    and cuts the stream every `length` ids; its last sequence may be shorter. block: the ids, and the
    documents with the places where they start in it."""

    def run(batches):
        encoder, part, first = tokens.Encoder.of(path), TaskContext.get().partitionId(), 0
        ids, held, documents, ended = [], 0, [], False

        def cut(n):
            """A row of n sequences (the last of them with what there is), and what is left."""
            nonlocal ids, held, documents, first
            stream, size = np.concatenate(ids), n * length
            numbers, starts = (np.array(x, np.int64) for x in zip(*documents))
            inside = starts < size
            row = (part, first, n, _squeezed((stream[:size], numbers[inside], starts[inside])))
            ids, held, first = [stream[size:]], max(0, held - size), first + n
            documents = list(zip(numbers.tolist(), (starts - size).tolist()))
            while len(documents) > 1 and documents[1][1] <= 0:  # has ended before
                documents.pop(0)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _BLOCK.types)], schema=_BLOCK)

        for batch in batches:
            names = batch.column("doc_id").fill_null(NULL_ID).to_pylist()
            for low, high, found, ends in encoder.runs(batch.column("text")):
                starts = held + np.append(0, ends + np.arange(1, high - low + 1))
                documents += zip(names[low:high], starts.tolist())
                ids.append(np.insert(_narrow(found), ends, tokens.END))
                held = int(starts[-1])
                while held >= BLOCK * length:
                    yield cut(BLOCK)
        if held:
            yield cut(-(-held // length))

    return texts(docs).mapInArrow(run, "part int, first long, rows int, block binary")


def write_training_order(docs: DataFrame, folder: str, length: int = LENGTH, key: int = 1234, path: str | None = None,
                         shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes all sequences of `docs` to shard files of unsigned 16-bit ids, a short one filled up with id 0, and
    their index beside them; returns the index: slot, shard, n_tokens, ids_crc32 of its ids, record_crc32 of the
    whole record, doc_ids in their order in it.

    Sequences are numbered by the task that made them and their place in it,
    from a written table, so a lost executor changes no slot. A null text is END
    alone, a null id -2**63; repeated rows are documents of their own; no rows: no files.
    """
    spark, stride = docs.sparkSession, 2 * length
    per_shard = max(1, shard_bytes // stride)
    made = materialize(sequences(docs, length, path or tokens.vocabulary()), "order-sequences")
    counts = {r["part"]: r["n"] for r in made.groupBy("part").agg(F.sum("rows").alias("n")).collect()}
    parts = sorted(counts)
    total = sum(counts.values())
    begins = dict(zip(parts, np.cumsum([0, *[counts[p] for p in parts]]).tolist()))

    def deal(batches):
        held, size = [], 0

        def send():
            slot = np.concatenate([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held])
            others = [y for x in held for y in x[2]]
            shard = slot // per_shard
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                row = (int(shard[own[0]]), _squeezed((slot[own], ids[own], [others[i] for i in own.tolist()])))
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.binary())], names=["shard", "sent"])

        for batch in batches:
            for part, first, rows, block in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "rows", "block"))):
                stream, numbers, starts = _opened(block)
                slot = permuted(begins[part] + first + np.arange(rows), total, key)
                ids = np.zeros(rows * length, "<u2")
                ids[: len(stream)] = stream
                sizes = np.minimum(length, len(stream) - np.arange(rows) * length).tolist()
                low = (np.searchsorted(starts, np.arange(rows) * length, side="right") - 1).tolist()
                high = np.searchsorted(starts, np.arange(1, rows + 1) * length).tolist()
                held.append((slot, ids.reshape(rows, length), [(n, numbers[max(0, a) : b].tolist()) for n, a, b in zip(sizes, low, high)]))
                size += rows
            if size >= DEALT:
                yield from send()
                held, size = [], 0
        if held:
            yield from send()

    shards = max(1, -(-total // per_shard))
    dealt = made.mapInArrow(deal, "shard int, sent binary").repartitionById(shards, F.col("shard"))

    def write(batches):
        whole, index, shard = np.zeros((per_shard, length), "<u2"), {}, None
        for batch in batches:
            for shard, sent in zip(batch.column("shard").to_pylist(), batch.column("sent").to_pylist()):
                slot, ids, others = _opened(sent)
                whole[slot % per_shard] = ids
                for s, record, (n, numbers) in zip(slot.tolist(), ids, others):
                    index[s] = (s, shard, n, zlib.crc32(record[:n].tobytes()), zlib.crc32(record.tobytes()), numbers)
        if index:
            write_whole(folder, f"shard-{shard:06d}.bin", [whole[: len(index)].tobytes()])
            rows = [index[s] for s in sorted(index)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), _INDEX.types)], schema=_INDEX)

    dealt.mapInArrow(write, _INDEX_DDL).write.parquet(f"{folder.rstrip('/')}/index")
    return spark.read.schema(_INDEX_DDL).parquet(f"{folder.rstrip('/')}/index")


_BLOCK = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("rows", pa.int32()), ("block", pa.binary())])
_INDEX = pa.schema([("slot", pa.int64()), ("shard", pa.int32()), ("n_tokens", pa.int32()), ("ids_crc32", pa.int64()), ("record_crc32", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
_INDEX_DDL = "slot long, shard int, n_tokens int, ids_crc32 long, record_crc32 long, doc_ids array<long>"


def read_training_order(spark: SparkSession, folder: str, total: int, start: int = 0, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(slot, ids) of the slots from `start` to `total`, a task per shard; ids: bytes of a whole stride."""
    stride = 2 * length
    per_shard = max(1, shard_bytes // stride)

    def run(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                store, path = opened(folder)
                low, high = max(start, shard * per_shard), min(total, (shard + 1) * per_shard)
                with store.open_input_file(f"{path}/shard-{shard:06d}.bin") as file:
                    file.seek((low - shard * per_shard) * stride)
                    for at in range(low, high, 1024):
                        data = file.read(stride * (min(high, at + 1024) - at))
                        rows = [data[i : i + stride] for i in range(0, len(data), stride)]
                        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.binary())], names=["slot", "ids"])

    first, shards = start // per_shard, -(-total // per_shard)
    return spark.range(first, max(first, shards), 1, max(1, shards - first)).mapInArrow(run, "slot long, ids binary")


def order_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "training-order")
