"""Claims, sessions and log entries derived from the star-schema test tables.

The joins carry no broadcast hint: Spark broadcasts a side only after checking
its size, and otherwise shuffles, splitting skewed partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimsift.session import DEFAULTS, materialize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", DEFAULTS["spark.sql.session.timeZone"])
    return spark.read.parquet(f"{folder}/{name}.parquet")


def days(amount: Column) -> Column:
    return F.make_dt_interval(days=amount.cast("int"))


def hours(amount: Column) -> Column:
    return F.make_dt_interval(hours=amount.cast("int"))


# What each column of a claim is made of.
LINE_COLUMNS = {
    "TransactionID": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    "PatientID": ["l_orderkey", "l_linenumber"],
    "Hospital_PIN": ["l_suppkey"],
    "Age": ["o_custkey"],
    "Gender": ["o_custkey"],
    "Primary_Diagnosis": ["p_type"],
    "Final_Billed_Amount": ["l_extendedprice"],
    "Base_Package_Rate": ["l_partkey", "p_retailprice", "l_quantity"],
    "Admission_Timestamp": ["o_orderdate", "l_linenumber"],
    "Discharge_Timestamp": ["o_orderdate", "l_linenumber", "l_partkey", "l_suppkey"],
    "PreAuth_Request_Date": ["o_orderdate", "l_suppkey"],
    "PreAuth_Approval_Date": ["o_orderdate", "l_suppkey", "l_tax", "l_partkey"],
}


def claims(spark: SparkSession, folder: str, stored: bool = False, columns: list[str] | None = None) -> DataFrame:
    """One claim per line item, with all columns or those named.

    ``stored`` is for queries that read the claims several times: the three
    tables are joined once and the joined rows written, numbers rather than the
    texts made of them; else every reading shuffles the line items again. Only
    what the ``columns`` are made of is shuffled and written.
    """
    line, order, part = (table(spark, folder, n) for n in ("lineitem", "orders", "part"))
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    if stored:
        made_of = [LINE_COLUMNS[c] for c in columns or LINE_COLUMNS]
        joined = materialize(joined.select(*dict.fromkeys(n for names in made_of for n in names)), "lines")
    start = F.col("o_orderdate").cast("timestamp")
    request = start - days(F.col("l_suppkey") % 5)
    stay = F.col("l_linenumber") * 3 + (F.col("l_partkey") % 12) * 24 + F.col("l_suppkey") % 24 - 12
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    values = [
        F.concat(F.lit("T"), F.concat_ws("-", *[F.col(c).cast("string") for c in names])).alias("TransactionID"),
        F.concat(F.lit("P"), F.concat_ws("-", *[F.col(c).cast("string") for c in names[:2]])).alias("PatientID"),
        F.col("l_suppkey").alias("Hospital_PIN"),
        (F.lit(20) + F.col("o_custkey") % 70).cast("int").alias("Age"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("Male")).otherwise(F.lit("Female")).alias("Gender"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("Maternity Care")).otherwise(F.col("p_type")).alias("Primary_Diagnosis"),
        F.col("l_extendedprice").alias("Final_Billed_Amount"),
        F.when(F.col("l_partkey") % 40 == 0, F.lit(0.0))
        .otherwise(F.col("p_retailprice") * F.col("l_quantity") * 2)
        .alias("Base_Package_Rate"),
        (start + hours(F.col("l_linenumber") * 3)).alias("Admission_Timestamp"),
        (start + hours(stay)).alias("Discharge_Timestamp"),
        request.alias("PreAuth_Request_Date"),
        F.when(F.col("l_tax") != 0, request + days(F.col("l_partkey") % 4)).alias("PreAuth_Approval_Date"),
    ]
    made = dict(zip(LINE_COLUMNS, values))
    return joined.select(*[made[c] for c in columns or LINE_COLUMNS])


def upload_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """One session per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    account = F.col("user_id").cast("string")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        account.alias("uid"),
        account.alias("user_id"),
        F.concat(F.lit("batch_"), F.col("event_id").cast("string"), F.lit(".csv")).alias("filename"),
        k.alias("total_rows"),
        (k - k % 3).alias("new_rows"),
        (k % 3).alias("skipped_rows"),
        (k % 7).alias("fraud_detected"),
        F.col("value").alias("suspicious_amt"),
        F.col("ts").cast("timestamp").alias("uploaded_at"),
    )


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """One log entry per event."""
    account = F.col("user_id").cast("string")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        account.alias("uid"),
        account.alias("user_id"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("description"),
        F.lit("").alias("patient_id"),
        F.lit("").alias("fraud_type"),
        F.col("value").alias("amount"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


