"""Table schemas and the fixed column lists shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The transaction, decision and feature vocabularies.
TXN_TYPES = ("PAYMENT", "TRANSFER", "CASH_OUT", "CASH_IN", "DEBIT")
DUMMY_TYPES = ("TRANSFER", "CASH_OUT", "CASH_IN", "DEBIT")
DECISIONS = ("APPROVE", "REVIEW", "BLOCK")
MODEL_FEATURES = (
    "amount",
    "error_balance_orig",
    "error_balance_dest",
    "type_TRANSFER",
    "type_CASH_OUT",
    "type_CASH_IN",
    "type_DEBIT",
    "orig_tx_count_1h",
    "orig_amount_sum_1h",
    "dest_tx_count_1h",
)
MONEY_FEATURES = ("amount", "error_balance_orig", "error_balance_dest", "orig_amount_sum_1h")
DUMMY_FEATURES = tuple(f"type_{t}" for t in DUMMY_TYPES)
BALANCES = ("oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")
TRAIN_MAX_STEP = 500

# Fields of the file layout, in file order. `event_id` is the total order of a table.
FILE_SCHEMA = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("nameOrig", T.StringType()),
        T.StructField("oldbalanceOrg", T.DoubleType()),
        T.StructField("newbalanceOrig", T.DoubleType()),
        T.StructField("nameDest", T.StringType()),
        T.StructField("oldbalanceDest", T.DoubleType()),
        T.StructField("newbalanceDest", T.DoubleType()),
        T.StructField("isFraud", T.IntegerType()),
        T.StructField("isFlaggedFraud", T.IntegerType()),
    ]
)
TXN_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), *FILE_SCHEMA.fields])
TXN_COLUMNS = tuple(TXN_SCHEMA.names)
WIRE_FIELDS = tuple(n for n in FILE_SCHEMA.names if n != "isFlaggedFraud")

CONTRIBUTIONS = T.ArrayType(
    T.StructType(
        [T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())]
    )
)

DECISION_SCHEMA = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("nameOrig", T.StringType()),
        T.StructField("nameDest", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("type", T.StringType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("decision", T.StringType()),
        T.StructField("top_features", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("is_fraud_ground_truth", T.IntegerType()),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("pr_auc", T.DoubleType()),
        T.StructField("improvement", T.DoubleType()),
        T.StructField("trigger", T.StringType()),
        T.StructField("drift_score", T.DoubleType()),
        T.StructField("promoted", T.BooleanType()),
        T.StructField("trained_at", T.TimestampType()),
    ]
)

# Wire names next to the snake_case names used by API clients.
SNAKE_NAMES = {
    "nameOrig": "name_orig",
    "nameDest": "name_dest",
    "oldbalanceOrg": "old_balance_orig",
    "newbalanceOrig": "new_balance_orig",
    "oldbalanceDest": "old_balance_dest",
    "newbalanceDest": "new_balance_dest",
    "isFraud": "is_fraud",
    "isFlaggedFraud": "is_flagged_fraud",
}
