"""Fixed values of the profiling and scoring rules.

Every word list, pattern and numeric constant here is part of the result
contract: changing one changes the answers.
"""

from __future__ import annotations

# Header tokens -------------------------------------------------------------
ID_TOKENS = ["id", "identifier"]
DATE_TOKENS = ["date", "time", "timestamp", "created", "updated", "month", "year", "day"]
CURRENCY_TOKENS = [
    "revenue", "charge", "charges", "cost", "price", "amount", "payment", "fee", "salary", "income", "spend",
]
PERCENT_TOKENS = ["percent", "percentage", "pct", "rate", "ratio", "share"]
COUNT_TOKENS = [
    "count", "counts", "calls", "visits", "clicks", "qty", "quantity", "number", "messages", "orders", "tickets",
]
DURATION_TOKENS = [
    "duration", "tenure", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "time",
]
EMAIL_TOKENS = ["email", "mail"]
PHONE_TOKENS = ["phone", "mobile", "telephone", "cell"]
URL_TOKENS = ["url", "uri", "website", "site", "web", "link"]
POSTAL_TOKENS = ["zip", "postal", "postcode", "pincode"]
LATITUDE_TOKENS = ["lat", "latitude"]
LONGITUDE_TOKENS = ["lon", "lng", "longitude"]
LOCATION_TOKENS = ["city", "state", "region", "province", "country"]

# Value patterns ------------------------------------------------------------
EMAIL_PATTERN = r"(?i)^[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}$"
PHONE_PATTERN = r"^\+?[0-9][0-9\-\s().]{6,}$"
URL_PREFIX_PATTERN = r"(?i)^(?:https?://|www\.)"
URL_EXACT_PATTERN = r"(?i)^(?:https?://|www\.)$"
DATE_LIKE_PATTERN = r"(?:\d{4}[-/]\d{1,2}[-/]\d{1,2})|(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4})|(?:\d{1,2}:\d{2})"

BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n", "0", "1"]

ORDINAL_SCALES = [
    ["low", "medium", "high"],
    ["low", "med", "high"],
    ["poor", "fair", "good", "excellent"],
    ["small", "medium", "large"],
    ["bronze", "silver", "gold", "platinum"],
    ["very low", "low", "medium", "high", "very high"],
]

INFERRED_TYPES = ["numeric", "categorical", "boolean", "datetime", "text", "unknown"]

# Missing tokens of the public pandas CSV reader ----------------------------
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

MISSING_LABEL = "<missing>"

# Target recommendation -----------------------------------------------------
OUTCOME_HINTS = [
    "churn", "attrition", "cancel", "cancellation", "retention", "renewal", "default", "fraud",
    "response", "outcome", "target", "label", "converted", "conversion",
]
EXACT_OUTCOME_NAMES = OUTCOME_HINTS + ["class", "status", "result"]
GROUPING_HINTS = ["segment", "tier", "band", "bucket", "group"]

# Positive labels -----------------------------------------------------------
POSITIVE_HINTS = ["1", "true", "yes", "y", "positive", "pos"]
PROBE_POSITIVE_HINTS = ["1", "true", "yes", "y", "positive", "pos", "high", "success", "passed", "pass"]

# Learnability probe --------------------------------------------------------
PROBE_ROWS = 1800
PROBE_TARGETS = 4
PROBE_MIN_SCORE = 0.52
PROBE_WEIGHT = 0.22
PROBE_MAX_CLASSES = 12
PROBE_MAX_CATEGORIES = 16
PROBE_MIN_ROWS = 80

# Supervised benchmark ------------------------------------------------------
TRAIN_ROWS = 5000
REPORT_ROWS = 2400
NUMERIC_FEATURES = 18
CATEGORICAL_FEATURES = 10
PREVIEW_ROWS = 40
MAX_CATEGORIES = 12
MIN_CATEGORY_SHARE = 0.01
FOREST_TREES = 72
EXTRA_TREES = 96
IDENTIFIER_SHARE = 0.92
MIN_SUPERVISED_ROWS = 40

# Unsupervised scan ---------------------------------------------------------
SCAN_ROWS = 4000
SCAN_FEATURES = 16
SCAN_PREVIEW_ROWS = 120
ISOLATION_TREES = 80
ISOLATION_SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42

# Data quality recommendations ----------------------------------------------
ADVICE_MISSING = "Review columns with more than 20% missing values before running models or reports."
ADVICE_CONSTANT = "Drop constant columns — they don't carry useful information."
ADVICE_CORRELATED = "Consider dropping one column from highly correlated pairs to reduce overlap."
ADVICE_OUTLIERS = "Check numeric outliers to separate data entry mistakes from genuinely unusual values."
ADVICE_CLEAN = "Quality looks good — no major cleanup needed before exploring the data."

# Insight next steps --------------------------------------------------------
STEP_MISSING = "Decide whether to fill in or remove heavily missing columns before running models."
STEP_DUPLICATES = "Remove duplicate rows before running final analysis or models."
STEP_CORRELATED = "Check highly correlated columns for overlap before running ML."
STEP_READY = "This dataset looks ready for ML if you want to explore it."
STEP_NOT_READY = "Review and clean the data first — there isn't enough structure for ML yet."
