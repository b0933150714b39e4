"""Generated telemetry files: one CSV per profile and replicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import known, to_timestamp

# Storage types of the columns that have one.
COLUMN_TYPES = {
    "case_id": "smallint",
    "row_idx": "int",
    "label": "tinyint",
    "latitude": "float",
    "longitude": "float",
    "altitude": "float",
    "speed": "float",
    "heading": "float",
    "original_row_idx": "int",
}
_FLOATS = [name for name, kind in COLUMN_TYPES.items() if kind == "float"]
_LAYOUT = r"/rep_(\d+)/([^/]+)\.csv"


def _typed(name: str, wide_ids: bool) -> Column:
    if name == "timestamp":
        return to_timestamp(F.col(name)).alias(name)
    kind = COLUMN_TYPES.get(name)
    if kind is None:
        return F.col(name)
    if name == "case_id" and wide_ids:
        kind = "int"
    value = F.col(name).cast(kind)
    if kind == "float":
        value = known(value).cast("float")
    return value.alias(name)


def read_telemetry(spark: SparkSession, paths: str | list[str], wide_ids: bool = False) -> DataFrame:
    """Typed telemetry of any number of CSV files in one scan.

    Columns are taken by header name and every file's header is checked against
    the first. Bad timestamps become missing, bad numbers are an error. Files
    laid out as rep_NN/<profile>.csv get `replicate` and `profile` from their
    path. `wide_ids` widens case_id for tables with more flights than a 16-bit
    id can number.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("header", True)
    header = reader.csv(paths)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in header.schema.fields])
    raw = reader.schema(text).option("enforceSchema", False).csv(paths)
    path = F.col("_metadata.file_path")
    typed = raw.select(*[_typed(name, wide_ids) for name in raw.columns], path.alias("_path"))
    matched = F.col("_path").rlike(_LAYOUT)
    derived = {
        "profile": F.regexp_extract("_path", _LAYOUT, 2),
        "replicate": F.regexp_extract("_path", _LAYOUT, 1).try_cast("int"),
    }
    for name, value in derived.items():
        fallback = F.col(name).cast("int" if name == "replicate" else "string") if name in raw.columns else F.lit(None)
        typed = typed.withColumn(name, F.when(matched, value).otherwise(fallback))
    return typed.drop("_path")


def write_telemetry(df: DataFrame, path: str) -> None:
    """Parquet partitioned by profile and replicate, rows of a flight kept in order."""
    ordered = df.repartitionByRange("profile", "replicate", "case_id", "row_idx")
    ordered = ordered.sortWithinPartitions("profile", "replicate", "case_id", "row_idx")
    ordered.write.mode("overwrite").partitionBy("profile", "replicate").parquet(path)
