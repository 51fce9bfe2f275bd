"""Column names, types and constants shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: names, limits and tables that give the data its meaning ---

REQUIRED = [
    "obj_id",
    "ob_code",
    "ra",
    "dec",
    "priority",
    "exptime",
    "resolution",
    "reference_arm",
]

OPTIONAL = ["pmra", "pmdec", "parallax", "tract", "patch"]
OPTIONAL_DEFAULTS = {"pmra": 0.0, "pmdec": 0.0, "parallax": 1e-7, "tract": None, "patch": None}

FILTERS = {
    "g": ["g_hsc", "g_ps1", "g_sdss", "bp_gaia"],
    "r": ["r_old_hsc", "r2_hsc", "r_ps1", "r_sdss", "g_gaia"],
    "i": ["i_old_hsc", "i2_hsc", "i_ps1", "i_sdss", "rp_gaia"],
    "z": ["z_hsc", "z_ps1", "z_sdss"],
    "y": ["y_hsc", "y_ps1"],
    "j": [],
}

ARMS = ["b", "r", "n", "m"]
RESOLUTIONS = ["L", "M"]
FORBIDDEN_ARMS = [("L", "m"), ("M", "r")]  # (resolution, arm) pairs that may not occur
STRING_PATTERN = r"^[A-Za-z0-9_+\-\.]+$"

FIELD_DIAMETER = 1.38  # deg
FIELD_RADIUS = FIELD_DIAMETER / 2.0
N_FIBERS = 2394
N_CALIBRATION = 200  # fibres kept free for calibrators
SINGLE_EXPTIME = 900.0  # s
WEIGHTS = (2.02, 0.01, 0.01)
ELEVATION = (30.0, 85.0)  # deg
NIGHT_START = "18:30:00"
NIGHT_END = "05:30:00"  # on the following day
SITE_TIMEZONE = "Pacific/Honolulu"
SITE_LATITUDE = 19.8255  # deg north
SITE_LONGITUDE = -155.4761  # deg east
PIXEL_NSIDE = 32
MAX_REQUEST_HOURS = 35.0
LARGE_LIST = 100_000
MAX_RESIDUAL_ROUNDS = 10

# texts that stand for a missing number in a CSV cell
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- derived names ---

BAND_OF = {name: band for band, names in FILTERS.items() for name in names}
FILTER_NAMES = [name for names in FILTERS.values() for name in names]
RESOLVED_FLUX = [f"{kind}_{band}" for kind in ("filter", "flux", "flux_error") for band in FILTERS]
REGISTERED = REQUIRED + OPTIONAL + RESOLVED_FLUX

TARGET_TYPES = {
    "obj_id": T.LongType(),
    "ob_code": T.StringType(),
    "ra": T.DoubleType(),
    "dec": T.DoubleType(),
    "priority": T.IntegerType(),
    "exptime": T.DoubleType(),
    "resolution": T.StringType(),
    "reference_arm": T.StringType(),
    "pmra": T.DoubleType(),
    "pmdec": T.DoubleType(),
    "parallax": T.DoubleType(),
    "tract": T.LongType(),
    "patch": T.LongType(),
}
POINTING_TYPES = {
    "ppc_code": T.StringType(),
    "ppc_ra": T.DoubleType(),
    "ppc_dec": T.DoubleType(),
    "ppc_pa": T.DoubleType(),
    "ppc_resolution": T.StringType(),
    "ppc_priority": T.DoubleType(),
}
POINTING_REQUIRED = ["ppc_ra", "ppc_dec", "ppc_resolution"]

LIST_COLS = ["upload_id"]
