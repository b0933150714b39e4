"""Packs pieces of documents into sequences by a grouping genetic algorithm.

Pieces of equal length are alike, so the counts per length (at most `capacity`
of them, whatever the corpus) state the whole problem. A solution maps patterns
(the lengths in a sequence, longest first) to how many sequences have them; so
a gene is a group of whole bins. Islands evolve solutions in tasks of their own
and hand their best to the next island; every piece then finds its place by its
number among those of its length.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import tokens
from .common import chunks_for, numbered, tidy, unused

CAPACITY = 2048
ISLANDS, MIGRATIONS, GENERATIONS, POPULATION = 6, 2, 6, 6

Bins = dict[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int, bins: Bins, order: list[int]) -> Bins:
    """`bins` with `counts` more pieces, each length in turn into the fullest sequences that have room."""
    out: Counter = Counter()
    room: dict[int, Counter] = {}
    for pattern, n in bins.items():
        room.setdefault(capacity - sum(pattern), Counter())[pattern] += n
    gaps = sorted(g for g in room if g)

    def add(gap, pattern, n):
        if gap not in room:
            room[gap] = Counter()
            if gap:
                insort(gaps, gap)
        room[gap][pattern] += n

    for length in order:
        left = counts.get(length, 0)
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    add(capacity - each * length, (length,) * each, full)
                if rest:
                    add(capacity - rest * length, (length,) * rest, 1)
                break
            gap = gaps[at]
            group = room[gap]
            pattern, n = next(iter(group.items()))
            each = min(gap // length, left)
            used = min(n, left // each)
            left -= used * each
            group[pattern] -= used
            if not group[pattern]:
                del group[pattern]
                if not group:
                    del room[gap], gaps[at]
            add(gap - each * length, tuple(sorted(pattern + (length,) * each, reverse=True)), used)
    for group in room.values():
        out.update(group)
    return dict(out)


def contents(bins: Bins) -> Counter:
    """Pieces per length."""
    out: Counter = Counter()
    for pattern, n in bins.items():
        for length in pattern:
            out[length] += n
    return out


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones; smaller is better."""
    return sum(bins.values()), -sum(n * (sum(p) / capacity) ** 2 for p, n in bins.items())


def _noisy(lengths, rng, noise: float) -> list[int]:
    lengths = np.array(sorted(lengths, reverse=True))
    return lengths[np.argsort(-lengths * (1 + noise * rng.random(len(lengths))), kind="stable")].tolist()


def crossover(one: Bins, other: Bins, counts: dict[int, int], capacity: int, rng) -> Bins:
    """Injects well-filled bins of `one` whole, keeps the bins of `other` that hold no piece
    twice, dissolves the rest and best-fits the displaced pieces, longest first."""
    share = 0.3 + 0.6 * rng.random()
    limit = int(sum(one.values()) * share)
    child: Bins = {}
    for pattern in sorted(one, key=lambda p: (capacity - sum(p), rng.random())):
        take = min(limit, one[pattern])
        if not take:
            break
        child[pattern] = take
        limit -= take
    open_ = Counter(counts)
    open_.subtract(contents(child))
    for pattern in sorted(other, key=lambda p: (capacity - sum(p), rng.random())):
        need = Counter(pattern)
        n = min(other[pattern], *(open_[length] // k for length, k in need.items()))
        if n > 0 and capacity - sum(pattern) <= capacity // 8:
            child[pattern] = child.get(pattern, 0) + n
            for length, k in need.items():
                open_[length] -= n * k
    displaced = {length: n for length, n in open_.items() if n > 0}
    return best_fit(displaced, capacity, child, sorted(displaced, reverse=True))


def mutate(bins: Bins, capacity: int, rng) -> Bins:
    """Dissolves the emptiest bins and some others and best-fits their pieces in a somewhat changed order."""
    kept, gone = {}, {}
    for pattern, n in bins.items():
        drop = n if capacity - sum(pattern) > capacity // 16 else int(rng.binomial(n, 0.05))
        if drop:
            gone[pattern] = drop
        if n > drop:
            kept[pattern] = n - drop
    pieces = contents(gone)
    return best_fit(pieces, capacity, kept, _noisy(pieces, rng, 0.1))


def evolve(counts: dict[int, int], capacity: int, elites: list[Bins], seed, generations: int, population: int) -> Bins:
    """The best solution of an island."""
    rng = np.random.default_rng(seed)
    people = list(elites)
    for i in range(population - len(people)):
        people.append(best_fit(counts, capacity, {}, _noisy(counts, rng, 0.15 * i)))
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    for _ in range(generations):
        people.sort(key=lambda b: fitness(b, capacity))
        if sum(people[0].values()) <= least:
            break
        half = max(2, len(people) // 2)
        children = []
        while len(children) < len(people) - half:
            a, b = sorted(rng.choice(half, 2, replace=False))
            child = crossover(people[a], people[b], counts, capacity, rng)
            children.append(mutate(child, capacity, rng) if rng.random() < 0.5 else child)
        people = people[:half] + children
    return min(people, key=lambda b: fitness(b, capacity))


def _blob(x) -> bytes:
    return zlib.compress(pickle.dumps(x), 1)


def solve(spark, counts: dict[int, int], capacity: int = CAPACITY, seed: int = 5, islands: int = ISLANDS,
          migrations: int = MIGRATIONS, generations: int = GENERATIONS, population: int = POPULATION) -> Bins:
    """Islands in tasks; after each round an island gets the elite of the one before it.

    The driver holds one solution per island: patterns over at most `capacity` lengths.
    """
    elites: list[Bins] = []
    for step in range(migrations):

        def run(batches, step=step, elites=elites):
            for batch in batches:
                for island in batch.column("id").to_pylist():
                    start = [elites[island], elites[island - 1]] if elites else []
                    best = evolve(counts, capacity, start, (seed, step, island), generations, population)
                    yield pa.RecordBatch.from_arrays([pa.array([island]), pa.array([_blob(best)], pa.binary())], names=["island", "best"])

        rows = spark.range(0, islands, 1, islands).mapInArrow(tidy(run), "island long, best binary").collect()
        elites = [pickle.loads(zlib.decompress(r.best)) for r in sorted(rows, key=lambda r: r.island)]
        least = -(-sum(length * n for length, n in counts.items()) // capacity)
        if min(sum(b.values()) for b in elites) <= least:
            break
    return min(elites, key=lambda b: fitness(b, capacity))


def places(bins: Bins) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first piece number, first sequence and offset of every run of places."""
    runs: dict[int, list] = {}
    base = 0
    for pattern in sorted(bins, reverse=True):
        offset = 0
        for length in pattern:
            own = runs.setdefault(length, [[0], [], []])
            own[0].append(own[0][-1] + bins[pattern])
            own[1].append(base)
            own[2].append(offset)
            offset += length
        base += bins[pattern]
    return {length: tuple(np.array(x, np.int64) for x in own) for length, own in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, order=("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with column `length` (1 to capacity).

    Other columns go along. Rows are numbered among those of their length, so
    repeated rows get a place each. An empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"pieces have 1 to {capacity} tokens")
    table = places(solve(spark, counts, capacity)) if counts else {}
    total = sum(counts.values())
    chunk = F.pmod(F.xxhash64(*order), F.lit(chunks_for(total)))
    (rank_,) = unused(pieces.columns, "rank")
    ranked = numbered(pieces, ["length"], [F.col(c) for c in order], chunk, rank_)

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", rank_))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for own in np.unique(length).tolist():
                at = np.nonzero(length == own)[0]
                starts, bases, offsets = table[own]
                run_ = np.searchsorted(starts, rank[at], side="right") - 1
                sequence[at], offset[at] = bases[run_] + rank[at] - starts[run_], offsets[run_]
            out = batch.drop_columns([rank_])
            yield out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    names = [f.name for f in pieces.schema]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long, offset long"])
    return ranked.select(*names, rank_).mapInArrow(tidy(run), schema)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): texts and END cut into pieces of `capacity` ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def make(doc, piece, start, data):
        return (doc, piece, start, len(data) // 4, zlib.crc32(data)) + ((data,) if ids else ())

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return tokens.map_pieces(docs, capacity, path or tokens.vocabulary(), make, names, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset; a null or empty text is END alone."""
    pieces = materialize(token_pieces(docs, capacity, path, ids), "packing-pieces")
    return pack(pieces, capacity, ("doc_id", "piece", "ids_crc32"))
