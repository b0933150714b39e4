"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample turns vectors into balanced
64-bit codes. Each code is entered in TABLES tables, one per substring of 16
bits, under the substring and its 16 neighbours; two codes whose substrings
differ in at most two bits share an entry. Pairs of codes within RADIUS bits
are then decided by the cosine of the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components

#: Rows that the rotation is learned from, those with the smallest hashes.
SAMPLE = 20_000
BITS, TABLES = 64, 4
#: At the threshold (21.6 degrees) a balanced code of 64 bits differs in 8 bits on average.
RADIUS = 16
THRESHOLD = 0.93
ITERATIONS = 40


def learn(sample: np.ndarray, seed: int = 3, iterations: int = ITERATIONS) -> np.ndarray:
    """The rotation for unit rows: principal axes, then in turn the codes and the best rotation to them.

    The axes go through the origin, not through the mean, so that code bits keep
    following the angle between vectors where all of them lie close together.
    Fewer than BITS dimensions are padded by random mixtures of the axes, of more the BITS largest count.
    """
    rng = np.random.default_rng(seed)
    size = sample.shape[1]
    values, axes = np.linalg.eigh(sample.T @ sample if len(sample) else np.eye(size))
    axes = axes[:, np.argsort(-values)][:, :BITS]
    if axes.shape[1] < BITS:
        axes = np.concatenate([axes, axes @ rng.normal(size=(axes.shape[1], BITS - axes.shape[1]))], 1)
    projected = sample @ axes
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(iterations if len(sample) else 0):
        u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
        turn = (u @ v).T
    return axes @ turn


def codes(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """A signed 64-bit code per unit row."""
    return np.packbits(vectors @ rotation >= 0, axis=1, bitorder="little").view("<i8").ravel()


def usable(vector: list | None) -> bool:
    """Has components, none of them null or not finite, and not all zero."""
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def unit_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, label, unit) of the vectors that can link; unit: doubles, packed."""

    def run(batches):
        for batch in batches:
            ids, labels, vectors = (batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))
            rows = []
            for i, label, vector in zip(ids, labels, vectors):
                if label is not None and usable(vector):
                    x = np.array(vector, float)
                    x /= np.abs(x).max()  # the squares of very large or small components stay finite
                    rows.append((i, label, (x / np.linalg.norm(x)).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary()))], names=["vec_id", "label", "unit"]
                )

    slim = table.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return slim.mapInArrow(run, "vec_id long, label string, unit binary")


def _coded(nodes: DataFrame) -> DataFrame:
    """Adds code, by a rotation for each vector size in the sample (other sizes: an unlearned one), and size."""
    chosen = nodes.orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE).select("unit").collect()
    rows = [np.frombuffer(r.unit) for r in chosen]
    sizes = sorted({len(r) for r in rows})
    models = {n: learn(np.stack([r for r in rows if len(r) == n])) for n in sizes}

    def run(batches):
        for batch in batches:
            units = [np.frombuffer(u) for u in batch.column("unit").to_pylist()]
            out = np.zeros(len(units), np.int64)
            for n in {len(u) for u in units}:
                at = [i for i, u in enumerate(units) if len(u) == n]
                model = models[n] if n in models else learn(np.zeros((0, n)))
                out[at] = codes(np.stack([units[i] for i in at]), model)
            yield batch.append_column("code", pa.array(out)).append_column("size", pa.array([len(u) for u in units], pa.int32()))

    return nodes.mapInArrow(run, "node long, label string, unit binary, copies long, code long, size int")


def candidates(coded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs a < b of nodes with equal label and size whose codes share an entry and differ in at most `radius` bits.

    A pair is made where its first table and, in it, its smallest entry is
    shared, so it is made once. An entry with very many codes is split by AQE.
    """
    width = BITS // TABLES
    flips = F.array(*[F.lit(m) for m in [0, *(1 << b for b in range(width))]])
    parts = F.array(*[F.struct(F.lit(t).alias("t"), F.expr(f"shiftrightunsigned(code, {t * width}) & {(1 << width) - 1}").alias("part")) for t in range(TABLES)])
    entries = (
        coded.select("label", "size", "node", "code", F.explode(parts).alias("p"))
        .select("label", "size", "node", "code", "p.*")
        .withColumn("entry", F.explode(F.transform(flips, lambda m: F.col("part").bitwiseXOR(m))))
    )
    side = lambda node, code, part: entries.select("label", "size", "t", "entry", F.col("node").alias(node), F.col("code").alias(code), F.col("part").alias(part))
    pairs = side("a", "x", "u").join(side("b", "y", "v"), ["label", "size", "t", "entry"])
    differ = F.col("x").bitwiseXOR(F.col("y"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius)
    for t in range(1, TABLES):  # no earlier table has the pair
        earlier = [F.bit_count(F.shiftrightunsigned(differ, s * width).bitwiseAND(F.lit((1 << width) - 1))) > 2 for s in range(t)]
        clear = earlier[0]
        for e in earlier[1:]:
            clear = clear & e
        close = close & ((F.col("t") != t) | clear)
    # Shared entries: all 17 of equal parts, both parts at distance 1, the two between at distance 2.
    apart = F.col("u").bitwiseXOR(F.col("v"))
    low = apart.bitwiseAND(-apart)
    first = (
        F.when(apart == 0, F.col("entry") == F.col("u"))
        .when(F.bit_count(apart) == 1, F.col("entry") == F.least("u", "v"))
        .otherwise(F.col("entry") == F.least(F.col("u").bitwiseXOR(low), F.col("v").bitwiseXOR(low)))
    )
    return pairs.where(close & first).select("a", "b")


def _links(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, copies of each) of the pairs whose cosine reaches the threshold."""
    mine = nodes.select(F.col("node").alias("a"), F.col("unit").alias("p"), F.col("copies").alias("copies_a"))
    other = nodes.select(F.col("node").alias("b"), F.col("unit").alias("q"), F.col("copies").alias("copies_b"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist())) for c in ("p", "q"))
                ends = np.cumsum([len(x) // 8 for x in batch.column("p").to_pylist()])
                cosine = np.add.reduceat(p * q, np.concatenate([[0], ends[:-1]]))
                yield batch.select(["a", "b", "copies_a", "copies_b"]).filter(pa.array(cosine >= threshold))

    return pairs.join(mine, "a").join(other, "b").select("a", "b", "copies_a", "copies_b", "p", "q").mapInArrow(
        run, "a long, b long, copies_a long, copies_b long"
    )


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors with one direction and label are one node with a count, so copies
    make no pairs. A vector that cannot link, and one without a label, stands
    alone. Repeated vec_ids are vectors of their own; a null one counts as -2**63.
    """
    table = table.withColumn("vec_id", F.coalesce(F.col("vec_id").cast("long"), F.lit(-(1 << 63))))
    vectors = materialize(unit_vectors(table), "embedding-units")
    nodes = vectors.groupBy("label", "unit").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.select(F.xxhash64("label", "unit").alias("node"), "label", "unit", "copies", "first"), "embedding-nodes")
    coded = materialize(_coded(nodes.select("node", "label", "unit", "copies")), "embedding-codes")
    pairs = materialize(candidates(coded, radius), "embedding-pairs")
    links = materialize(_links(pairs, nodes, threshold), "embedding-links")
    both = links.select(F.col("a").alias("node"), F.col("copies_b").alias("n")).unionByName(links.select(F.col("b").alias("node"), F.col("copies_a").alias("n")))
    count = both.groupBy("node").agg(F.sum("n").alias("others"))
    ids = nodes.select("node", "first")
    named = links.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(named, "embedding").toDF("first", "component")
    told = nodes.join(count, "node", "left").join(found, "first", "left").select(
        "label", "unit", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")
    )
    linked = vectors.join(materialize(told, "embedding-told"), ["label", "unit"]).select("vec_id", "n_links", "component_id")
    able = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    fit = F.coalesce(able & sound, F.lit(False)) & F.col("label").isNotNull()
    alone = table.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
