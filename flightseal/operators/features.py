"""Per-flight kinematic and temporal features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CASE_KEYS, FEATURES, GAP_S, LOCATION_FEATURES, MAX_DT_S, MEASURED, ORDER, ROLLED, ROLLING_ROWS
from ..functions.convert import cap, holds, known
from ..functions.kinematics import haversine_m, per_second, seconds_between, turn_deg
from .ordering import flights


def engineer_features(
    df: DataFrame, keys: Sequence[str] = CASE_KEYS, order: str = ORDER, limit: int | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """All columns of `df` plus the 20 derived features. `ties`: columns that order rows of equal `order`.

    Needs `timestamp` and the measured columns. Everything that looks at other
    rows is computed over one set of per-flight windows, so the plan has a
    single exchange and sort of the rows. Select only the columns you need
    afterwards: unused features are pruned from the windows.
    """
    data = flights(df.withColumns({name: known(F.col(name)) for name in MEASURED}), keys, order, limit, ties)
    if data.cut:
        ends = data.long_rows.groupBy(*data.part).agg(F.max(order).alias("_end"))
        data.add(ends.select(*data.part, F.max("_end").over(data.all_blocks()).alias("_end")))
        data.add(data.preceding_rows(ROLLING_ROWS - 1, ["timestamp", *MEASURED]))
    data.rows = data.rows.withColumn("_end", F.col(order))

    window = data.window()
    recent = window.rowsBetween(1 - ROLLING_ROWS, 0)
    neighbours = {f"_prev_{name}": F.lag(name).over(window) for name in ("timestamp", *MEASURED)}
    neighbours |= {f"_mean_{name}": F.avg(name).over(recent) for name in ROLLED}
    neighbours |= {f"roll_std_{name}": F.stddev_samp(name).over(recent) for name in ROLLED}
    neighbours["_flight_end"] = F.max("_end").over(Window.partitionBy(*data.part))
    rows = data.real(data.with_context().withColumns(neighbours), "_end")

    here, prev = F.col, lambda name: F.col(f"_prev_{name}")
    rows = rows.withColumns(
        {
            "_dt": seconds_between(here("timestamp"), prev("timestamp")),
            "dist_m": haversine_m(prev("latitude"), prev("longitude"), here("latitude"), here("longitude")),
            "d_alt_m": here("altitude") - prev("altitude"),
        }
    )
    dt = here("_dt")
    rows = rows.withColumn("speed_gps_mps", per_second(here("dist_m"), dt))
    rows = rows.withColumns(
        {
            "dt_s": cap(dt, MAX_DT_S),
            "ts_gap_flag": holds(dt > GAP_S).cast("byte"),
            "d_lat_deg": here("latitude") - prev("latitude"),
            "d_lon_deg": here("longitude") - prev("longitude"),
            "speed_resid_mps": here("speed") - here("speed_gps_mps"),
            "accel_mps2": per_second(here("speed") - prev("speed"), dt),
            "alt_rate_mps": per_second(here("d_alt_m"), dt),
            "d_heading_deg": turn_deg(here("heading"), prev("heading")),
            "row_frac": F.try_divide(here(order).cast("double"), here("_flight_end").cast("double")),
            **{f"roll_dev_{name}": here(name) - here(f"_mean_{name}") for name in ROLLED},
        }
    )
    helpers = ["_dt", "_flight_end", *[n for n in neighbours if n.startswith(("_prev_", "_mean_"))]]
    return rows.drop(*helpers)


def feature_matrix(
    features: DataFrame, keep: Sequence[str] = (), names: Sequence[str] = FEATURES
) -> DataFrame:
    """`keep` plus the named features in model order, narrowed to float (flag: byte)."""
    narrow = [F.col(n).cast("byte" if n == "ts_gap_flag" else "float").alias(n) for n in names]
    return features.select(*keep, *narrow)


def without_location(names: Sequence[str] = FEATURES) -> list[str]:
    """Feature names of the transfer variant."""
    return [name for name in names if name not in LOCATION_FEATURES]
