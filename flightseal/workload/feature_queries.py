"""Feature windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DERIVED_FEATURES, FEATURES
from ..operators.features import engineer_features, feature_matrix
from .view import q, q_sql, telemetry, telemetry_sql

# Columns that are compared at 1e-7 instead of 1e-4: degrees.
_DEGREES = {"d_lat_deg", "d_lon_deg", "roll_dev_latitude", "roll_std_latitude", "roll_dev_longitude", "roll_std_longitude"}

GROUPS = {
    "feat_time": ["dt_s", "ts_gap_flag"],
    "feat_deltas": ["d_lat_deg", "d_lon_deg", "d_alt_m"],
    "feat_distance": ["dist_m"],
    "feat_kinematics": ["speed_gps_mps", "speed_resid_mps", "accel_mps2", "alt_rate_mps"],
    "feat_heading": ["d_heading_deg"],
    "feat_row_frac": ["row_frac"],
    "feat_rolling": list(DERIVED_FEATURES[12:]),
    "features_all": list(FEATURES),
}


def _scale(name: str) -> int:
    return 10_000_000 if name in _DEGREES else 10_000


def features(spark, sf_dir):
    return engineer_features(telemetry(spark, sf_dir))


def _query(names, narrow=False):
    def run(spark, sf_dir):
        wide = features(spark, sf_dir)
        if narrow:
            wide = feature_matrix(wide, ["case_id", "row_idx"])
        return wide.select(
            "case_id",
            "row_idx",
            *[
                wide[n].cast("int").alias(n) if n == "ts_gap_flag" else q(n, _scale(n)).alias(n)
                for n in names
            ],
        )

    return run


def features_sql(source: str | None = None, keys: str = "case_id", narrow: bool = False) -> str:
    """All derived features over `source` as one SELECT for the comparison engine."""
    source = source or telemetry_sql()
    prev = "lag({c}) over w as p_{c}"
    measured = ["t_ms", "latitude", "longitude", "altitude", "speed", "heading"]
    lags = ", ".join(prev.format(c=c) for c in measured)
    rolled = ", ".join(
        f"avg({c}) over w10 as m_{c}, stddev_samp({c}) over w10 as roll_std_{c}"
        for c in ["altitude", "speed", "latitude", "longitude"]
    )
    base = f"""select *, {lags}, {rolled}, max(row_idx) over (partition by {keys}) as last_idx
 from ({source}) window w as (partition by {keys} order by row_idx),
 w10 as (partition by {keys} order by row_idx rows between 9 preceding and current row)"""
    step = f"""select *, (t_ms - p_t_ms) / 1000.0E0 as dt,
 2 * 6371000.0E0 * asin(sqrt(
  power(sin(radians(latitude - p_latitude) / 2), 2)
  + cos(radians(p_latitude)) * cos(radians(latitude)) * power(sin(radians(longitude - p_longitude) / 2), 2)))
  as dist_m from ({base})"""
    out = f"""select *,
 case when dt is not null then least(dt, 3600.0E0) end as dt_s,
 case when coalesce(dt > 60, false) then 1 else 0 end as ts_gap_flag,
 latitude - p_latitude as d_lat_deg, longitude - p_longitude as d_lon_deg, altitude - p_altitude as d_alt_m,
 dist_m / nullif(dt, 0) as speed_gps_mps, speed - dist_m / nullif(dt, 0) as speed_resid_mps,
 (speed - p_speed) / nullif(dt, 0) as accel_mps2, (altitude - p_altitude) / nullif(dt, 0) as alt_rate_mps,
 (heading - p_heading + 540.0E0) - 360.0E0 * floor((heading - p_heading + 540.0E0) / 360.0E0) - 180.0E0 as d_heading_deg,
 row_idx / cast(nullif(last_idx, 0) as double) as row_frac,
 altitude - m_altitude as roll_dev_altitude, speed - m_speed as roll_dev_speed,
 latitude - m_latitude as roll_dev_latitude, longitude - m_longitude as roll_dev_longitude
 from ({step})"""
    return out


def _sql(names, narrow=False):
    def one(n):
        if n == "ts_gap_flag":
            return n
        return f"{q_sql(f'cast({n} as float)' if narrow else n, _scale(n))} as {n}"

    return f"select case_id, row_idx, {', '.join(one(n) for n in names)} from ({features_sql()})"


# Flights whose order values repeat, are sparse, or are missing; `seq` decides.
_UNCLEAR = """case case_id % 4 when 0 then cast(floor(row_idx / 5.0E0) as int) when 1 then row_idx * 1000
 when 2 then case when row_idx % 3 <> 1 then row_idx end else row_idx end"""
_NAMES = ["dt_s", "ts_gap_flag", "d_alt_m", "d_heading_deg", "roll_dev_altitude", "roll_std_speed", "row_frac"]


def unclear_order(spark, sf_dir):
    return telemetry(spark, sf_dir).withColumn("seq", F.col("row_idx")).withColumn("row_idx", F.expr(_UNCLEAR))


def unclear_order_sql() -> str:
    return f"select * replace (({_UNCLEAR}) as row_idx), row_idx as seq from ({telemetry_sql()})"


def features_unclear_order(spark, sf_dir):
    wide = engineer_features(unclear_order(spark, sf_dir), ties=["seq"])
    return wide.select("case_id", "seq", *[F.col(n).cast("int").alias(n) if n == "ts_gap_flag" else q(n).alias(n) for n in _NAMES])


def _unclear_sql() -> str:
    wide = features_sql(unclear_order_sql()).replace("order by row_idx", "order by row_idx nulls first, seq")
    return f"select case_id, seq, {', '.join(n if n == 'ts_gap_flag' else f'{q_sql(n)} as {n}' for n in _NAMES)} from ({wide})"


QUERIES = {key: _query(names, key == "features_all") for key, names in GROUPS.items()}
ORACLE = {key: _sql(names, key == "features_all") for key, names in GROUPS.items()}
QUERIES["features_unclear_order"] = features_unclear_order
ORACLE["features_unclear_order"] = _unclear_sql()
