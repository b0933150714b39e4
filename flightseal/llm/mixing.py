"""Mixes sources to target weights by Poisson replication.

A source that should give the share w of the mix, and has b of all B bytes,
gets the mean repetition rate w * B / b. Each document inverts the Poisson
distribution of that mean at a uniform number from its hash, is copied that
often (or not at all), and all copies are shuffled by another hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import materialize
from .common import tidy, unused

#: A larger mean is the sum of draws with means of at most this, so exp(-mean) stays a normal number.
PART = 256.0
#: A document whose source has a larger mean rate is copied by several tasks, each at most this many times.
RANGE = 1024


def invert(uniform: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The smallest k with P(X <= k) >= uniform, X Poisson with this mean of at most PART."""
    k = np.zeros(len(uniform), np.int64)
    term = np.exp(-mean)
    total = term.copy()
    open_ = total < uniform
    while open_.any():
        k[open_] += 1
        term[open_] *= mean[open_] / k[open_]
        more = total[open_] + term[open_]
        ended = (more == total[open_]) & (k[open_] > mean[open_])  # nothing is left to add
        total[open_] = more
        at = np.nonzero(open_)[0]
        open_[at] = (more < uniform[at]) & ~ended
    return k


def uniforms(hashes: np.ndarray, part: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit hashes, unlike for each part."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64) + np.uint64((part + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def draws(hashes: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Poisson counts with these means, decided by the hashes alone."""
    means = np.nan_to_num(np.asarray(means, float), nan=0.0).clip(0)
    total, parts = np.zeros(len(means), np.int64), np.maximum(1, np.ceil(means / PART))
    for part in range(int(parts.max(initial=0))):
        on = parts > part
        total[on] += invert(uniforms(hashes[on], part), (means / parts)[on])
    return total


@F.pandas_udf(LongType())
def _copies(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def run(batches):
        for hashes, means in batches:
            yield pd.Series(draws(hashes.to_numpy(np.int64).view(np.uint64), means.to_numpy(float)))

    yield from tidy(run)(batches)


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """(mix_source, mean rate): byte counts of all documents per source against the wanted shares.

    weights: source to weight, scaled to sum 1; a source that is not named gets
    none. None: equal weights. Sources without bytes get rate 0.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(size).cast("double").alias("bytes"))
    if weights is None:
        wanted = sizes.withColumn("weight", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        wanted = sizes.join(named, F.col("mix_source").eqNullSafe(F.col("name")), "left").select("mix_source", "bytes", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = wanted.agg(F.sum("bytes").alias("all_bytes"), F.sum(F.when(F.col("bytes") > 0, F.col("weight"))).alias("all_weight")).first()
    share = F.col("weight") / F.lit(total.all_weight or 1.0)
    rate = F.when(F.col("bytes") > 0, share * F.lit(total.all_bytes or 0.0) / F.nullif("bytes", F.lit(0.0)))
    return wanted.select("mix_source", F.coalesce(rate, F.lit(0.0)).alias("mean_rate"))


def replicate(docs: DataFrame, weights: Mapping[str | None, float] | None = None, seed: int = 29) -> DataFrame:
    """Every document as often as drawn, in a global random order; adds copy (from 0), mean_rate, mix_order.

    The hash takes the seed, doc_id and text, so repeated rows draw alike and
    the result does not depend on partitions or retries. mix_order is the key
    of the shuffle: rows are dealt and sorted by it. A null source is a source;
    a null text has no bytes and draws by its source's rate like any other row,
    and so does a null doc_id; an empty table stays empty. Columns that share
    the added names are replaced. Sources with a rate above RANGE are read
    apart, and ranges of a document's copies are dealt before they are made.
    """
    docs = docs.drop("copy", "mean_rate", "mix_order", "mix_source")
    mean = materialize(rates(docs, weights), "mixing-rates")  # its size known, the texts need not be dealt by source
    copies, part = unused(docs.columns, "copies", "part")
    own = F.xxhash64(F.lit(seed), "doc_id", "text")
    drawn = docs.join(mean, docs["source"].eqNullSafe(mean["mix_source"])).drop("mix_source")
    numbers = lambda first, end: F.explode(F.sequence(first.cast("int"), (end - 1).cast("int")))

    def of(rows: DataFrame) -> DataFrame:
        return rows.withColumn(copies, _copies(own, F.col("mean_rate"))).where(F.col(copies) > 0)

    made = of(drawn.where(F.col("mean_rate") <= RANGE)).withColumn("copy", numbers(F.lit(0), F.col(copies))).drop(copies)
    if mean.where(F.col("mean_rate") > RANGE).head(1):
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = of(drawn.where(F.col("mean_rate") > RANGE)).withColumn(part, numbers(F.lit(0), F.ceil(F.col(copies) / RANGE)))
        parts = parts.repartition(tasks, F.xxhash64(F.lit(seed + 2), "doc_id", "text", part))
        ends = F.least(F.col(copies), (F.col(part) + 1).cast("long") * RANGE)
        made = made.unionByName(parts.withColumn("copy", numbers(F.col(part) * RANGE, ends)).drop(copies, part))
    return shuffled(made, F.xxhash64(F.lit(seed + 1), "doc_id", "text", "copy"))


def shuffled(df: DataFrame, key: Column) -> DataFrame:
    """Global random order: dealt by a hash key (column mix_order) and sorted by it where it lies."""
    return df.withColumn("mix_order", key).repartition("mix_order").sortWithinPartitions("mix_order")
