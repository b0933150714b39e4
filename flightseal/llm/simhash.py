"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint has 64 bits on a ring of `SEGMENTS` segments. If two differ in at
most t bits, then from some segment on every chain of l consecutive segments
differs in at most l*t/SEGMENTS bits (rounded down). The first segments of that
chain have budget zero, so they are equal and serve as the join key; the
budgets of the longer chains prune candidates before the whole distance counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import columns, components, map_batches, texts, unused

SEGMENTS = 8
#: A join key shared by more distinct fingerprints than this is linked by `_balls` instead of by pairs.
BUCKET = 64
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles, repeats included, as a signed long.

    A-Z are lowered; words are runs without ASCII white space. A text with
    fewer words is one shingle; without any (null too) the fingerprint is 0.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
        return int(np.array(hashes, np.uint64).view(np.int64)[0])
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[: -words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = [digest(line[a:b], 42) for a, b in zip(starts[at : at + SHINGLES_AT_ONCE], stops[at : at + SHINGLES_AT_ONCE])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    major = np.packbits(total * 2 > len(starts), bitorder="little")
    return int(major.view("<i8")[0])


def _text_hash(text):
    """MD5 of a text column, empty for null; as `fingerprints` has it."""
    return F.coalesce(F.md5(text), F.lit(""))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is a long."""

    def run(batch):
        ids, bodies = columns(batch, "doc_id", "text")
        hashes = ["" if t is None else hashlib.md5(t.encode()).hexdigest() for t in bodies]
        return ids, hashes, [fingerprint(t, words) for t in bodies]

    return map_batches(texts(docs), run, "doc_id long, text_hash string, fp long")


def _rings(distinct: DataFrame, bits: int) -> DataFrame:
    """A row per fingerprint and chain start: the ring turned so that the chain leads, and its key."""
    step = 64 // SEGMENTS
    equal = sum(1 for n in range(1, SEGMENTS) if n * bits < SEGMENTS)  # leading segments without budget
    turned = F.when(F.col("start") == 0, F.col("fp")).otherwise(
        F.expr(f"shiftleft(fp, cast(start * {step} as int)) | shiftrightunsigned(fp, cast(64 - start * {step} as int))")
    )
    return (
        distinct.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))
        .withColumn("ring", turned)
        .withColumn("key", F.shiftrightunsigned("ring", 64 - step * equal))
    )


def _balls(hot: DataFrame) -> DataFrame:
    """Links of fingerprints that share a centre at distance 0 or 1, each to the centre's smallest.

    Two fingerprints differ in at most two bits exactly if they share such a
    centre, and a centre has at most 65 distinct fingerprints, so a group of
    any size is linked by 65 rows for each of its members.
    """
    masks = [0, *[1 << b for b in range(63)], -(1 << 63)]
    centres = hot.select("rep", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in masks])).alias("centre"))
    least = centres.groupBy("centre").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return centres.join(least, "centre").where("rep <> b").select(F.col("rep").alias("a"), "b")


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b) that connect all (rep, fp) whose fingerprints differ in at most `bits` bits.

    Every pair that shares a key of at most BUCKET fingerprints is tested; the
    fingerprints of larger keys go through `_balls` (for two bits), with the
    same components and no pairs within a large group.
    """
    if bits != 2:
        raise ValueError("large keys are linked for two differing bits")
    step = 64 // SEGMENTS
    rings = materialize(_rings(distinct, bits), "simhash-rings")
    sizes = rings.groupBy("start", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = materialize(sizes, "simhash-keys")
    shared = materialize(rings.join(sizes, ["start", "key"]), "simhash-shared")
    cold, hot = shared.where(F.col("size") <= BUCKET), shared.where(F.col("size") > BUCKET)
    left = cold.select("start", "key", F.col("rep").alias("a"), F.col("ring").alias("x"))
    right = cold.select("start", "key", F.col("rep").alias("b"), F.col("ring").alias("y"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    close = F.col("a") > F.col("b")
    for length in range(1, SEGMENTS + 1):
        chain = F.bit_count(F.shiftrightunsigned(differ, 64 - step * length)) if length < SEGMENTS else F.bit_count(differ)
        close = close & (chain <= length * bits // SEGMENTS)
    pairs = left.join(right, ["start", "key"]).where(close).select("a", "b").distinct()
    return pairs.unionByName(_balls(hot.select("rep", "fp").distinct()))


def _grouped(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """(doc_id, text_hash, fp, first) of every row; first: the smallest (doc_id, text_hash) of its group.

    Fingerprints are the nodes, so copies cost a row each and no pairs, and rows
    are linked by their texts alone, whatever ids they have or share.
    """
    prints = fingerprints(docs, words).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    prints = materialize(prints, "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    distinct = materialize(distinct, "simhash-distinct")
    found = components(links(distinct.select(F.col("fp").alias("rep"), "fp"), bits), "simhash").withColumnRenamed("id", "fp")
    named = distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "simhash-named")
    firsts = named.groupBy("component").agg(F.min("least").alias("first"))
    firsts = materialize(named.join(firsts, "component").select("fp", "first"), "simhash-firsts")
    return prints.join(firsts, "fp").select("doc_id", "text_hash", "fp", "first")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id: the smallest doc_id of the group.

    Repeated doc_ids keep a row each; null ids are -2**63; empty tables give no rows.
    Groups without a link have the same component_id only where unlike rows share their smallest doc_id.
    """
    return _grouped(docs, words, bits).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """One row of each group: that with the smallest doc_id (null before all), then text hash. All columns stay.

    Of rows that share both, the one whose other columns come first (in the
    order of the columns, maps left out) stays. Null and empty texts are a
    group; an empty table stays empty.
    """
    id_, hash_ = unused(docs.columns, "id", "hash")
    own = F.struct("doc_id", "text_hash")
    drop = _grouped(docs, words, bits).where(own != F.col("first")).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    drop = materialize(drop.distinct(), "simhash-drop")
    keyed = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn(hash_, _text_hash("text"))
    left = keyed.join(drop, [id_, hash_], "left_anti")
    ordered = [f.name for f in docs.schema if f.name != "text" and "map<" not in f.dataType.simpleString()]
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*[F.col(f"`{c}`") for c in ordered]))
    first = left.groupBy(id_, hash_).agg(row.alias(hash_ + "row"))
    return first.select(*[F.col(hash_ + "row")[c].alias(c) for c in docs.columns])
