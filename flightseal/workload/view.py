"""A telemetry table derived from the whole `events` table.

The recipe is stated once as SQL expressions and used by both sides: Spark
numbers the rows with the skew-safe position operator, the comparison SQL with
row_number().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_position

# Profile -> factor on the manipulation strength.
STRENGTH = {"balanced": "1.0E0", "strong": "1.35E0", "subtle": "0.65E0"}
_STRENGTHS = ", ".join(f"struct('{name}' as profile, {factor} as strength)" for name, factor in STRENGTH.items())

_KINDS = """case cast(user_id % 9 as int) when 0 then 'altitude_spike' when 1 then 'combined'
 when 2 then 'coordinate_jump' when 3 then 'deletion_gap' when 4 then 'heading_inconsistency'
 when 5 then 'injection' when 6 then 'precision_rounding' when 7 then 'speed_inconsistency'
 else 'timestamp_drift' end"""

_MARKED = {
    "label": "case when event_type = 'error' and user_id % 12 <> 0 then 1 else 0 end",
    "kind": _KINDS,
}

_COLUMNS = {
    "case_id": "cast(user_id as int)",
    "row_idx": "row_idx",
    "replicate": "cast(user_id % 4 as int)",
    "label": "label",
    "tamper_type": "case when label = 1 then kind else 'normal' end",
    "case_name": """concat('case_', lpad(cast(user_id as string), 4, '0'), '_',
 case when user_id % 12 = 0 then 'normal' else kind end)""",
    "t_ms": """case when row_idx = 0 then cast(0 as bigint)
 else 1726430400000 + cast(floor((row_idx * 100 + 2 * k) / 100.0E0) * 100 as bigint)
 - (case when label = 1 and k % 10 = 0 then 500 else 0 end)
 + (case when label = 1 and user_id % 9 = 3 and k % 5 = 0 then 90000 else 0 end) end""",
    "latitude": "8.0E0 + (row_idx * 100 + k) / 1.0E7 + label * (0.0005E0 * {strength})",
    "longitude": "98.0E0 + (row_idx * 100 - k) / 1.0E7",
    "altitude": "value + label * (20.0E0 * {strength})",
    "speed": "k / 10.0E0",
    "heading": "cast((k * 37 + row_idx * 5) % 360 as double)",
    "score_a": "floor(value + label * (40.0E0 * {strength})) / 100.0E0",
    "score_b": "floor(value + label * (15.0E0 * {strength})) / 100.0E0",
    "phase": """case when row_idx < 6 then 'TAKEOFF_AUTO'
 when user_id = 7 and row_idx between 50 and 59 then 'RTH' else 'WAYLINE' end""",
}


def _select(expressions: dict[str, str], strength: str = "1.0E0") -> list[str]:
    return [f"{text.format(strength=strength)} as {name}" for name, text in expressions.items()]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = events(spark, sf_dir).select(
        "user_id",
        "event_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    rows = with_position(raw, ["user_id"], "event_id", "row_idx")
    return rows.withColumn("row_idx", F.col("row_idx").cast("int")).selectExpr("*", *_select(_MARKED))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flight per user, ten rows a second, with a timestamp column."""
    out = _marked(spark, sf_dir).selectExpr(*_select(_COLUMNS))
    return out.withColumn("timestamp", F.timestamp_millis("t_ms"))


def all_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three profiles stacked, tagged by `profile`."""
    rows = _marked(spark, sf_dir).selectExpr("*", f"inline(array({_STRENGTHS}))")
    out = rows.selectExpr("profile", *_select(_COLUMNS, "strength"))
    return out.withColumn("timestamp", F.timestamp_millis("t_ms"))


def telemetry_sql(profile: str = "balanced") -> str:
    """The same table as one SELECT for the comparison engine."""
    numbered = """select user_id, event_id, event_type, value,
 cast(json_extract_string(props, '$.k') as int) as k,
 cast(row_number() over (partition by user_id order by event_id) - 1 as int) as row_idx from events"""
    marked = f"select *, {', '.join(_select(_MARKED))} from ({numbered})"
    return f"select {', '.join(_select(_COLUMNS, STRENGTH[profile]))} from ({marked})"


def all_profiles_sql() -> str:
    return " union all ".join(f"select *, '{p}' as profile from ({telemetry_sql(p)})" for p in STRENGTH)


RAW_LOG = {
    "case_id": "case_id",
    "row_idx": "row_idx",
    '"Timestamp"': "t_ms",
    '"Latitude"': "cast(latitude as string)",
    '"Longitude"': "longitude",
    '"Altitude(meters)"': "altitude",
    '"Speed(m/s)"': """case when cast(floor(speed * 10 + 0.5E0) as int) = 13 then 'n/a'
 else cast(speed as string) end""",
    '"Yaw"': "heading",
    '"ModeCode"': "case when row_idx % 3 = 1 then phase end",
}


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry as a foreign export: other header, dirty numbers, sparse phase."""
    columns = [f"{text} as {name}".replace('"', "`") for name, text in RAW_LOG.items()]
    return telemetry(spark, sf_dir).selectExpr(*columns)


def raw_log_sql() -> str:
    return f"select {', '.join(f'{text} as {name}' for name, text in RAW_LOG.items())} from ({telemetry_sql()})"


def q(value, scale: int = 10_000):
    """A float as a whole number of 1/scale, for comparing engines exactly."""
    column = F.col(value) if isinstance(value, str) else value
    return F.floor(column.cast("double") * float(scale) + 0.500001).cast("bigint")


def q_sql(expression: str, scale: int = 10_000) -> str:
    return f"cast(floor(cast({expression} as double) * {scale}E0 + 0.500001E0) as bigint)"
