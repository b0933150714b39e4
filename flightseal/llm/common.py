"""What several operators share: tokens of bytes, numbering without gaps, components."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows that one window task of `numbered` holds on average.
CHUNK_ROWS = 1 << 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of texts that go to a Python worker at once, where the session has Spark's default.
BATCH_ROWS = 1 << 10


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with the session's Arrow batches small enough for rows of long texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text), read in small batches."""
    return small_batches(docs).select(F.col("doc_id").cast("long"), "text")


#: What operators keep in this Python worker from task to task, by the module that keeps it.
_KEPT: dict[str, dict] = {}


def kept(module: str) -> dict:
    return _KEPT.setdefault(module, {})


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for workers that outlive their stage, as Spark reuses them for whatever comes next.

    What other modules kept goes before it starts, and memory that it freed
    goes back to the system when it ends.
    """

    def clean(batches):
        for other in [name for name in _KEPT if name != run.__module__]:
            del _KEPT[other]
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return clean


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """Names for helper columns, like `names` but unlike all `columns` (whatever the case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        made = f"{name}_"
        while made.lower() in taken:
            made += "_"
        out.append(made)
    return out


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(name).to_pylist() for name in names]


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """`function(batch)` returns the columns of its result, or None for no rows."""
    names = [field.split()[0] for field in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "boolean": pa.bool_(), "double": pa.float64()}
    kinds = [types[field.split()[1]] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch)
            if made is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds)], names=names)

    return df.mapInArrow(run, schema)


def chunks_for(rows: int, chunk_rows: int = CHUNK_ROWS) -> int:
    return max(1, math.ceil(rows / chunk_rows))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk: Column, name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2 ... without gaps within `keys`, by (chunk, order).

    Rows of a key are numbered within chunks, and each chunk starts where the
    counts of the chunks before it end. A key may hold any share of the rows:
    no task sorts more than a chunk of it, and what meets in one task is one
    count per chunk. `df` is read twice, so it should be a written table.
    """
    chunk_, rows_, start_, own_ = unused([*df.columns, name], "chunk", "rows", "start", "own")
    spread = df.withColumn(chunk_, chunk)
    by = [*keys, chunk_]
    counts = spread.groupBy(*by).agg(F.count(F.lit(1)).alias(rows_))
    before = Window.partitionBy(*keys).orderBy(chunk_).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, F.coalesce(F.sum(rows_).over(before), F.lit(0)).alias(start_))
    own = spread.withColumn(own_, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    left, right = own.alias("l"), starts.alias("r")
    same = F.lit(True)
    for key in by:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return left.join(right, same).select(
        *[f"l.{c}" for c in df.columns], (F.col(f"l.{own_}") + F.col(f"r.{start_}")).cast("long").alias(name)
    )


def _signature(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of every end of the links `a`-`b`; component: the smallest id reachable.

    Alternating large and small stars over tables in the shared folder: each
    round links every node to the smallest node it knows, by a map-side minimum
    and an equality join that AQE can split, so a node with very many links is
    no task of its own. Ends when a round changes nothing. No links: no rows.
    """
    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links"
    )
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, f"{name}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        edges = materialize(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct(), f"{name}-links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
