"""Column names, types, table layouts and profiles shared by every module."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

# Names of the claim input columns and the types they are read as.
CLAIM_TYPES = {
    "TransactionID": T.StringType(),
    "PatientID": T.StringType(),
    "Hospital_PIN": T.LongType(),
    "HospitalID": T.StringType(),
    "Age": T.IntegerType(),
    "Gender": T.StringType(),
    "Primary_Diagnosis": T.StringType(),
    "Disease": T.StringType(),
    "Final_Billed_Amount": T.DoubleType(),
    "TreatmentCost": T.DoubleType(),
    "Base_Package_Rate": T.DoubleType(),
    "Admission_Timestamp": T.TimestampType(),
    "Discharge_Timestamp": T.TimestampType(),
    "PreAuth_Request_Date": T.TimestampType(),
    "PreAuth_Approval_Date": T.TimestampType(),
}

TIME_COLUMNS = [c for c, t in CLAIM_TYPES.items() if isinstance(t, T.TimestampType)]

# Columns the batch profile cannot do without.
BATCH_REQUIRED = [
    "TransactionID",
    "PatientID",
    "Hospital_PIN",
    "Age",
    "Primary_Diagnosis",
    "Final_Billed_Amount",
    "Base_Package_Rate",
    *TIME_COLUMNS,
]

PROFILES = ("batch", "app")

# Detection settings of both profiles.
CONTAMINATION = 0.12
TREES = 200
SEED = 42

# Table layouts, their keys and their insert defaults. The default
# "now" stands for the time of the write.
TABLES: dict[str, T.StructType] = {
    "claims": T.StructType()
    .add("PatientID", "string")
    .add("Age", "integer")
    .add("Final_Billed_Amount", "double")
    .add("Fraud_Flag", "integer")
    .add("Risk_Score", "double")
    .add("Fraud_Type", "string")
    .add("AI_Justification", "string")
    .add("Risk score per claim", "double")
    .add("user_id", "string")
    .add("uploaded_at", "timestamp")
    .add("Investigation_Status", "string"),
    "upload_sessions": T.StructType()
    .add("id", "string")
    .add("uid", "string")
    .add("user_id", "string")
    .add("filename", "string")
    .add("total_rows", "long")
    .add("new_rows", "long")
    .add("skipped_rows", "long")
    .add("fraud_detected", "long")
    .add("suspicious_amt", "double")
    .add("uploaded_at", "timestamp"),
    "audit_log": T.StructType()
    .add("id", "string")
    .add("uid", "string")
    .add("user_id", "string")
    .add("action", "string")
    .add("description", "string")
    .add("patient_id", "string")
    .add("fraud_type", "string")
    .add("amount", "double")
    .add("created_at", "timestamp"),
    "detected_frauds": T.StructType()
    .add("PatientID", "string")
    .add("Age", "integer")
    .add("Primary_Diagnosis", "string")
    .add("Final_Billed_Amount", "double")
    .add("Fraud_Type", "string")
    .add("AI_Justification", "string")
    .add("Risk_Score", "double")
    .add("user_id", "string")
    .add("detected_at", "timestamp")
    .add("Investigation_Status", "string"),
    "ingest_batches": T.StructType()
    .add("batch_id", "string")
    .add("total", "long")
    .add("new", "long")
    .add("skipped", "long")
    .add("in_batch_duplicates", "long")
    .add("null_keys", "long")
    .add("ingested_at", "timestamp"),
}

TABLE_KEYS = {
    "claims": "PatientID",
    "upload_sessions": "id",
    "audit_log": "id",
    "detected_frauds": "PatientID",
    "ingest_batches": "batch_id",
}

TABLE_DEFAULTS: dict[str, dict[str, object]] = {
    "claims": {
        "Fraud_Flag": 0,
        "Risk_Score": 0.0,
        "Fraud_Type": "",
        "AI_Justification": "",
        "Risk score per claim": 0.0,
        "uploaded_at": "now",
    },
    "upload_sessions": {
        "total_rows": 0,
        "new_rows": 0,
        "skipped_rows": 0,
        "fraud_detected": 0,
        "suspicious_amt": 0.0,
        "uploaded_at": "now",
    },
    "audit_log": {"patient_id": "", "fraud_type": "", "amount": 0.0, "created_at": "now"},
    "detected_frauds": {
        "Primary_Diagnosis": "",
        "Fraud_Type": "Anomalous",
        "AI_Justification": "",
        "Risk_Score": 0.0,
        "detected_at": "now",
    },
    "ingest_batches": {"ingested_at": "now"},
}

# The columns a fraud case carries, when present.
FRAUD_COLUMNS = [
    "PatientID",
    "Age",
    "Primary_Diagnosis",
    "Final_Billed_Amount",
    "Fraud_Type",
    "AI_Justification",
    "Risk_Score",
    "user_id",
]

REPORT_COLUMNS = [
    "TransactionID",
    "PatientID",
    "Hospital_PIN",
    "Fraud_Type",
    "Final_Billed_Amount",
    "Risk_Score",
    "AI_Justification",
]


def has(df: DataFrame, *names: str) -> bool:
    """True when every name is a column of ``df`` (exact spelling)."""
    return set(names) <= set(df.columns)


def check_profile(profile: str) -> None:
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}, not {profile!r}")
