"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Blocks of rows are the senders. How many rows each block sends to each shard is
one draw of the matrix that a uniform permutation of all rows would give: at
every node of a binary tree over the blocks the shards' places are divided
between the two halves by hypergeometric draws, seeded by the node. So a block
walks from the root to its leaf and needs nobody else's draws. The tree is
drawn in levels of up to `FAN` branches a node, each level a job over its
nodes, so no task or driver holds the counts of all blocks. Rows are permuted
in their block, dealt by its counts, and permuted again in the shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import CHUNK_ROWS, chunks_for, numbered, unused

#: Branches of a node in one level of the tree over the blocks.
FAN = 1 << 10


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def _hypergeometric(rng, good: int, bad: int, draw: int) -> int:
    """numpy's generator takes populations below 10**9; for larger ones the distribution is inverted."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draw)) if draw else 0
    return _by_inverse(rng.random(), good, bad, draw)


def _by_inverse(u: float, good: int, bad: int, draw: int) -> int:
    """Inverts the distribution outwards from its mode; terms follow from log gamma, to about five digits."""
    from math import exp, lgamma

    low, high = max(0, draw - bad), min(good, draw)
    mode = min(max((draw + 1) * (good + 1) // (good + bad + 2), low), high)
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    top = exp(choose(good, mode) + choose(bad, draw - mode) - choose(good + bad, draw))
    total, left, right, lo, hi = top, top, top, mode, mode
    k = mode
    while total < u and (left > 0 or right > 0):
        left = left * lo * (bad - draw + lo) / ((good - lo + 1) * (draw - lo + 1)) if lo > low else 0.0
        right = right * (good - hi) * (draw - hi) / ((hi + 1) * (bad - draw + hi + 1)) if hi < high else 0.0
        lo, total = lo - (lo > low), total + left
        if total >= u:
            k = lo
            break
        hi, total = hi + (hi < high), total + right
        k = hi
    return k


def divide(places: np.ndarray, rows: int, seed: tuple[int, ...]) -> np.ndarray:
    """Of the shards' open places, those that `rows` of the sum(places) rows take."""
    rng, taken = np.random.Generator(np.random.PCG64(np.random.SeedSequence(seed))), np.zeros_like(places)
    rest = int(places.sum())
    for s, open_ in enumerate(places):
        rest -= int(open_)
        taken[s] = _hypergeometric(rng, int(open_), rest, rows)
        rows -= int(taken[s])
    return taken


def matrix_row(block: int, ends: np.ndarray, places: np.ndarray, seed: int, node: tuple[int, ...] = ()) -> np.ndarray:
    """Row counts from `block` to each shard. ends: running sum of the blocks' rows, from 0; node: where in the whole tree."""
    low, high = 0, len(ends) - 1
    while high - low > 1:
        middle = (low + high) // 2
        first = divide(places, int(ends[middle] - ends[low]), (seed, *node, low, high))
        if block < middle:
            high, places = middle, first
        else:
            low, places = middle, places - first
    return places


def matrix(counts: DataFrame, blocks: int, places: np.ndarray, seed: int, fan: int = FAN) -> DataFrame:
    """(node, ends) of every block that has rows: running sums of its counts to the shards.

    counts: (node, rows) by block number, from 0. A level joins the counts of
    up to `fan` children to each node's places and divides them.
    """
    spark = counts.sparkSession
    levels = [materialize(counts, "shard-counts")]
    while fan ** len(levels) < blocks:
        up = levels[0].groupBy((F.col("node") / fan).cast("long").alias("node")).agg(F.sum("rows").alias("rows"))
        levels.insert(0, materialize(up, "shard-counts"))
    found = spark.createDataFrame([(0, np.cumsum(places).tolist())], "node long, ends array<long>")
    for level, below in enumerate(levels):

        def divided(batches, level=level):
            for batch in batches:
                nodes, ends = [], []
                for parent, own, children in zip(*(batch.column(c).to_pylist() for c in ("parent", "ends", "children"))):
                    sums = np.cumsum([0, *(c["rows"] for c in children)])
                    for i, child in enumerate(children):
                        row = matrix_row(i, sums, np.diff(own, prepend=0), seed, (level, parent))
                        nodes.append(child["node"])
                        ends.append(np.cumsum(row).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["node", "ends"])

        grouped = below.groupBy((F.col("node") / fan).cast("long").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("node", "rows"))).alias("children"))
        joined = grouped.join(found, grouped["parent"] == found["node"]).select("parent", "ends", "children")
        found = materialize(joined.mapInArrow(divided, "node long, ends array<long>"), "shard-matrix")
    return found


def assign(df: DataFrame, key: str, shards: int, seed: int = 41, block_rows: int = CHUNK_ROWS, fan: int = FAN) -> DataFrame:
    """Adds shard and slot (gapless from 0 in the shard, in random order); sizes are at most one apart.

    Rows are dealt to blocks by all their columns, so rows that share a key
    (null too) do not share a block; rows that are equal in all columns do, get
    a place each and are interchangeable. An empty table stays empty. Columns
    that share the added names are replaced; maps cannot be hashed by Spark.
    """
    df = materialize(df.drop("shard", "slot"), "shard-rows")
    rows = df.count()
    blocks = chunks_for(rows, block_rows)
    block_, local_, ends_ = unused([*df.columns, "shard", "slot"], "block", "local", "ends")
    others = [F.col(f"`{c}`") for c in df.columns if c != key]
    sent = df.withColumn(block_, F.pmod(F.xxhash64(F.lit(seed), key, *others), F.lit(blocks)).cast("long"))
    counts = sent.groupBy(F.col(block_).alias("node")).agg(F.count(F.lit(1)).alias("rows"))
    sums = matrix(counts, blocks, shard_sizes(rows, shards), seed, fan).select(F.col("node").alias(block_), F.col("ends").alias(ends_))
    order = [F.xxhash64(F.lit(seed + 1), key), F.col(key), *others]
    local = numbered(sent, [block_], order, F.lit(0), local_)
    dealt = local.join(sums, block_).withColumn("shard", F.size(F.filter(ends_, lambda end: end <= F.col(local_))))
    dealt = materialize(dealt.drop(block_, ends_), "shard-dealt")
    mixed = lambda salt: F.xxhash64(F.lit(seed + salt), key, *others, local_)
    part = F.pmod(mixed(2), F.lit(chunks_for(rows // shards, block_rows)))
    return numbered(dealt, ["shard"], [mixed(3), F.col(key), F.col(local_)], part, "slot").drop(local_)
