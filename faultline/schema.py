"""Names, cutoffs and schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

CLASS = "class"
ROW_KEY = "row_key"
NEGATIVE, POSITIVE = "neg", "pos"

# The model's feature list, in model order.
TOP_FEATURES = (
    "CI_000", "AA_000", "AH_000", "BB_000", "BG_000", "BU_000", "BV_000",
    "CQ_000", "BT_000", "AN_000", "AO_000", "BH_000", "DN_000", "CC_000",
    "BX_000", "AQ_000", "AP_000", "CK_000", "BY_000", "BJ_000",
)

# The features the warehouse tables leave out.
EXCLUDED_FEATURES = (
    "AB_000", "BM_000", "BN_000", "BO_000", "BP_000", "BQ_000", "BR_000",
    "CR_000",
)

# Tokens read as a missing cell.
INGEST_NA_TOKENS = ("na", "NA", "NaN", "nan", "")
STRICT_NA_TOKENS = ("na",)
# What a CSV reader of the pandas family takes as missing unless told otherwise.
COMMON_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

PREAMBLE_LINES = 20
MISSING_SHARE_LIMIT = 0.50

# Three unrelated sets of cutoffs: class, risk level, maintenance priority.
CLASS_CUTOFF = 0.50
RISK_CUTOFFS = (("HIGH", 0.70), ("MEDIUM", 0.30))
RISK_FLOOR = "LOW"
PRIORITY_CUTOFFS = (("CRITICAL", 0.95), ("URGENT", 0.80), ("MONITOR", 0.50))
PRIORITY_FLOOR = "NORMAL"

LABELS = {0: "NO_FAILURE", 1: "FAILURE"}

# The text shown for each priority.
ACTIONS = {
    "CRITICAL": "Immediate inspection and preventive maintenance",
    "URGENT": "Schedule maintenance as soon as possible",
    "MONITOR": "Increase monitoring frequency",
}
ACTION_FLOOR = "Continue normal operation and routine monitoring"

# 0.10, 0.15 .. 0.90 kept as whole hundredths, so no float drift enters.
SWEEP_HUNDREDTHS = tuple(range(10, 91, 5))
MIN_RECALL = 0.85

SEED = 42
BALANCE_NEGATIVES = 1000
TRAIN_ROWS_PER_CLASS = 800
TEST_SHARE = 0.20
EXPLAIN_SAMPLE = 2000

PREDICTIONS = T.StructType([
    T.StructField("prediction_id", T.LongType(), False),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("prediction_label", T.StringType()),
    T.StructField("failure_probability", T.DoubleType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("row_key", T.StringType()),
    T.StructField("batch_id", T.StringType()),
])

METRICS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("model", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("train_rows", T.LongType()),
    T.StructField("test_rows", T.LongType()),
    T.StructField("features", T.IntegerType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
