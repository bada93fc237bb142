"""Schemas, column names and the fixed values reports depend on.

Everything here is data, not logic. Values under "Fixed values" must stay
exactly as written: report results depend on them.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the published analysis for identical results)
# ---------------------------------------------------------------------------

# Region whitelist: 50 states plus DC, in the order the analysis lists them.
US_STATE_CODES: tuple[str, ...] = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
)

# Population dimension: 49 rows (MO and WI are absent in the source list).
POPULATION_STATES: tuple[str, ...] = (
    "CA", "TX", "FL", "NY", "PA", "IL", "OH", "GA", "NC", "MI",
    "NJ", "VA", "WA", "AZ", "TN", "MA", "IN", "MD", "CO", "MN",
    "SC", "AL", "LA", "KY", "OR", "OK", "CT", "UT", "IA", "NV",
    "AR", "MS", "KS", "NM", "NE", "WV", "ID", "HI", "NH", "ME",
    "MT", "RI", "DE", "SD", "ND", "AK", "VT", "WY", "DC",
)
POPULATION_VALUES: tuple[int, ...] = (
    38965193, 30503301, 22610726, 19571216, 12961683,
    12549689, 11799448, 11029227, 10698973, 10037261,
    9290841, 8715698, 7812880, 7431344, 7126489, 7029917,
    6861936, 6180253, 5877610, 5737915, 5373555, 5108468,
    4590241, 4526154, 4233358, 4053624, 3617176, 3417734,
    3207004, 3194176, 3067732, 2940057, 2934582, 2114371,
    1967923, 1775156, 1939033, 1435138, 1402054, 1395722,
    1122867, 1093734, 1018396, 909824, 779261, 733583,
    647464, 584057, 689545,
)

# Response value that counts as monetary relief.
RELIEF_RESPONSE = "Closed with monetary relief"

# Risk bands: a z-score strictly above a cut gets the label; else the default.
RISK_CUTS: tuple[float, ...] = (2, 1, 0, -1)
RISK_LABELS: tuple[str, ...] = ("Critical", "Elevated", "Moderate", "Low")
RISK_DEFAULT = "Very Low"

# Trend classes.
TREND_ACCELERATING = "Accelerating"
TREND_DECELERATING = "Decelerating"
TREND_MIXED = "Mixed"

# Category merge: both credit reporting product names become one.
PRODUCT_MERGE: dict[str, str] = {
    "Credit reporting, credit repair services, or other personal consumer reports": "Credit Reporting",
    "Credit reporting or other personal consumer reports": "Credit Reporting",
}

# Source CSV header names of the five queried columns -> snake_case names.
SOURCE_COLUMNS: dict[str, str] = {
    "Date received": "date_received",
    "Product": "product",
    "State": "state",
    "Company response to consumer": "company_response",
    "Timely response?": "timely_response",
}

# Date floors, thresholds and limits used by the published reports.
HISTORY_SINCE = "2015-01-01"
MONTHLY_SINCE = "2020-01-01"
RECENT_SINCE = "2022-01-01"
BASELINE_SINCE = "2023-01-01"
CURRENT_SINCE = "2024-01-01"
MIN_BASE_MONTH = 100
TOP_PRODUCTS_PER_STATE = 5
ROLLING_QUARTERS = 4
ROLLING_DAY_ROWS = 90
SAMPLE_STATES: tuple[str, ...] = ("CA", "TX", "FL", "GA", "MS")

# ---------------------------------------------------------------------------
# Typed schemas
# ---------------------------------------------------------------------------

CASE_SCHEMA = T.StructType([
    T.StructField("date_received", T.DateType(), True),
    T.StructField("product", T.StringType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("company_response", T.StringType(), True),
    T.StructField("timely_response", T.BooleanType(), True),
])

POPULATION_SCHEMA = T.StructType([
    T.StructField("state", T.StringType(), False),
    T.StructField("population", T.LongType(), False),
])

SERIES_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), True),
    T.StructField("delinquency_rate", T.DoubleType(), True),
])

# Product x state export read back for the category merge.
PRODUCT_STATE_SCHEMA = T.StructType([
    T.StructField("product", T.StringType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("complaints", T.LongType(), True),
    T.StructField("relief_rate", T.DoubleType(), True),
])
