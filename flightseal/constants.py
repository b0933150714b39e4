"""Names and fixed values shared by the operators."""

from __future__ import annotations

# Labels and settings that results depend on.
TAMPER_TYPES = (
    "altitude_spike",
    "combined",
    "coordinate_jump",
    "deletion_gap",
    "heading_inconsistency",
    "injection",
    "precision_rounding",
    "speed_inconsistency",
    "timestamp_drift",
)
NORMAL = "normal"
SEED = 42
EARTH_RADIUS_M = 6_371_000.0
MAX_DT_S = 3600.0
GAP_S = 60.0
ROLLING_ROWS = 10
TARGET_DT_S = 2.0
RBF_SAMPLE_ROWS = 20_000
LEARNING_CURVE_ROWS = (5_000, 10_000, 20_000, 40_000)
LEARNING_CURVE_EVAL_ROWS = 120_000
Z_THRESHOLD = 4.0
MAD_TO_STD = 1.4826
MIN_SCALE = 1e-6
MIN_PHASE_ROWS = 20
ALTITUDE_QUANTILE = 0.995
ALTITUDE_HEADROOM = 2.0
ALTITUDE_FLOOR_MPS = 3.0
STATIONARY_MPS = 0.5

# Flight identity and order. Tables that hold several profiles or replicates
# pass ("profile", "replicate", "case_id") instead.
CASE_KEYS = ("case_id",)
FULL_KEYS = ("profile", "replicate", "case_id")
ORDER = "row_idx"

# Columns measured at every row, and the columns a rolling frame is taken over.
MEASURED = ("latitude", "longitude", "altitude", "speed", "heading")
ROLLED = ("altitude", "speed", "latitude", "longitude")

# The 25 model inputs in model order. Identifiers, labels and
# the raw timestamp are never features.
FEATURES = (
    "dt_s",
    "ts_gap_flag",
    "d_lat_deg",
    "d_lon_deg",
    "dist_m",
    "d_alt_m",
    "speed_gps_mps",
    "speed_resid_mps",
    "accel_mps2",
    "alt_rate_mps",
    "d_heading_deg",
    "row_frac",
    "roll_dev_altitude",
    "roll_std_altitude",
    "roll_dev_speed",
    "roll_std_speed",
    "roll_dev_latitude",
    "roll_std_latitude",
    "roll_dev_longitude",
    "roll_std_longitude",
    "altitude",
    "speed",
    "heading",
    "latitude",
    "longitude",
)
DERIVED_FEATURES = FEATURES[:20]

# Absolute place and route, left out of the transfer variant.
LOCATION_FEATURES = ("latitude", "longitude", "altitude", "heading")

# Features judged against their own phase by the label-free detector.
CONSISTENCY_FEATURES = (
    "dt_s",
    "speed_resid_mps",
    "accel_mps2",
    "d_heading_deg",
    "roll_dev_speed",
    "roll_dev_latitude",
    "roll_dev_longitude",
)

# Foreign log headers, first match wins.
COLUMN_CANDIDATES = {
    "latitude": ("Latitude", "latitude", "lat"),
    "longitude": ("Longitude", "longitude", "lon", "lng"),
    "altitude": ("Altitude(meters)", "Altitude", "altitude", "alt"),
    "speed": ("Speed(m/s)", "Speed", "speed"),
    "heading": ("Yaw", "Heading", "heading", "yaw"),
}
TIMESTAMP_CANDIDATES = ("Timestamp", "Time(millis)")
PHASE_CANDIDATES = ("ModeCode", "FlightMode", "Mode", "flight_mode", "mode")
TITLE_CANDIDATES = ("MissionName", "FlightLogName")
DEFAULT_PHASE = "flight"

# Cells of a foreign log that mean "missing", as pandas.read_csv takes them.
MISSING_WORDS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
