"""Figures, trends, queues and histories over claims, cases, sessions and log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimsift.functions import text as tx
from claimsift.functions.values import truncated_percent
from claimsift.schema import has


def flagged(df: DataFrame) -> DataFrame:
    """flagged claims."""
    return df.where(F.col("Fraud_Flag") == 1)


def for_user(df: DataFrame, user_id: str | None) -> DataFrame:
    """rows of one user; all rows without a user or a user column."""
    if not user_id or not has(df, "user_id"):
        return df
    return df.where(F.col("user_id") == user_id)


def for_account(df: DataFrame, uid: str) -> DataFrame:
    """rows that carry the account as user id or as plain id."""
    return df.where((F.col("user_id") == uid) | (F.col("uid") == uid))


def money(column: Column) -> Column:
    """A sum of amounts that does not depend on row order; 0 over no rows.

    Amounts are summed as decimals with six places; where one is beyond them
    (or infinite), the plain floating sum counts instead.
    """
    exact = column.try_cast("decimal(28,6)")
    beyond = F.count_if(column.isNotNull() & exact.isNull())
    whole = F.sum(exact).cast("double")
    return F.coalesce(F.when(beyond > 0, F.sum(column.cast("double"))).otherwise(whole), F.lit(0.0))


def total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def fraud_type_counts(df: DataFrame) -> DataFrame:
    """Claims per fraud type, most frequent first."""
    return df.groupBy("Fraud_Type").agg(F.count(F.lit(1)).alias("Counts")).orderBy(F.desc("Counts"), "Fraud_Type")


def batch_kpis(df: DataFrame, cost_col: str | None) -> DataFrame:
    """Rows, flagged rows, their share in percent and their billed sum."""
    hit = F.col("Fraud_Flag") == 1
    amount = money(F.when(hit, F.col(cost_col))) if cost_col else F.lit(0.0)
    rows, hits = F.count(F.lit(1)), F.count_if(hit)
    return df.agg(
        rows.alias("Total_Rows"),
        hits.alias("Fraud_Found"),
        F.round(hits * F.lit(100.0) / F.nullif(rows, F.lit(0)), 1).alias("Fraud_Percent"),
        amount.alias("Suspicious"),
    )


def dataset_counts(df: DataFrame) -> DataFrame:
    """A10: rows and flagged rows, 0 flagged where the frame has no flag."""
    flags = total(F.col("Fraud_Flag")) if has(df, "Fraud_Flag") else F.lit(0).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), flags.alias("n_fraud"))


def db_stats(claims: DataFrame, sessions: DataFrame, user_id: str | None = None, cost_col: str | None = None) -> DataFrame:
    """Totals of the claims table and of the upload sessions in one row.

    Both tables are stacked into one narrow frame, so a single aggregation with
    map-side combining serves them.
    """
    if cost_col is None:
        cost_col = next((c for c in ("Final_Billed_Amount", "TreatmentCost") if c in claims.columns), None)
    cost = F.col(cost_col).cast("double") if cost_col else F.lit(0.0)
    nothing = F.lit(None).cast("timestamp")
    stacked = for_user(claims, user_id).select(
        F.lit(1).alias("claim"), (F.col("Fraud_Flag") == 1).alias("hit"), cost.alias("cost"), nothing.alias("at")
    ).unionAll(
        for_user(sessions, user_id).select(F.lit(0), F.lit(False), F.lit(0.0), F.col("uploaded_at"))
    )
    last = F.date_format(F.max("at"), "dd MMM yyyy")
    return stacked.agg(
        total(F.col("claim")).alias("total_claims"),
        F.count_if("hit").alias("total_fraud"),
        money(F.when(F.col("hit"), F.col("cost"))).alias("suspicious_amt"),
        F.coalesce(last, F.lit("Never")).alias("last_updated"),
        F.count_if(F.col("claim") == 0).alias("total_uploads"),
    )


def user_activity(sessions: DataFrame, uid: str) -> DataFrame:
    """Claims analysed and frauds found by one account, 0 without sessions."""
    return for_account(sessions, uid).agg(
        total(F.col("total_rows")).alias("total_claims"), total(F.col("fraud_detected")).alias("total_frauds")
    )


def activity_by_user(sessions: DataFrame) -> DataFrame:
    """A07 for every account at once; a session counts once per id it carries."""
    ids = F.array_distinct(F.array_compact(F.array("user_id", "uid")))
    return (
        sessions.select(F.explode(ids).alias("account"), "total_rows", "fraud_detected")
        .groupBy("account")
        .agg(total(F.col("total_rows")).alias("total_claims"), total(F.col("fraud_detected")).alias("total_frauds"))
    )


def newest_sessions(sessions: DataFrame, limit: int = 100) -> DataFrame:
    """The newest sessions; ties by id."""
    return sessions.orderBy(F.desc("uploaded_at"), F.desc("id")).limit(limit)


def daily_trend(sessions: DataFrame, user_id: str | None = None, newest: int | None = None, n_days: int | None = None) -> DataFrame:
    """Flagged and total claims per day, oldest day first.

    All days, unless ``n_days`` keeps the days up to that many before the last
    one, or ``newest`` that many sessions.
    """
    rows = for_user(sessions, user_id).withColumn("Date", F.to_date("uploaded_at"))
    if n_days is not None:
        last = rows.agg(F.max("Date").alias("Last")).scalar()
        rows = rows.where(F.col("Date") > F.date_sub(last, n_days))
    elif newest is not None:
        rows = newest_sessions(rows, newest)
    return (
        rows.groupBy("Date")
        .agg(total(F.col("fraud_detected")).alias("Flagged"), total(F.col("total_rows")).alias("Total"))
        .orderBy("Date")
    )


def audit_summary(cases: DataFrame) -> DataFrame:
    """Number of cases, their billed sum and label, mean risk in whole percent."""
    amount = money(F.col("Final_Billed_Amount"))
    mean_risk = F.sum(F.col("Risk_Score").cast("decimal(18,4)")).cast("double") / F.nullif(
        F.count("Risk_Score"), F.lit(0)
    )
    return cases.agg(
        F.count(F.lit(1)).alias("Cases"),
        amount.alias("Total_Amount"),
        tx.fmt_amount(amount).alias("Total_Label"),
        truncated_percent(mean_risk).alias("Avg_Risk_Percent"),
    )


def fraud_queue(cases: DataFrame) -> DataFrame:
    """Cases by falling risk; ties by patient."""
    return cases.orderBy(F.desc("Risk_Score"), "PatientID")


def top_cases(cases: DataFrame, k: int) -> DataFrame:
    """The first ``k`` cases of the queue."""
    return fraud_queue(cases).limit(k)


def upload_history(sessions: DataFrame, uid: str | None = None, limit: int = 10) -> DataFrame:
    """Newest sessions of an account (or of all) with a readable time."""
    rows = sessions if not uid else sessions.where(F.col("uid") == uid)
    label = tx.datetime_label(F.col("uploaded_at").cast("string"))
    return newest_sessions(rows, limit).withColumn("date_label", label)


def recent_audit(log: DataFrame, uid: str, as_of: Column, limit: int = 20) -> DataFrame:
    """Newest log entries of an account and how long ago they were made."""
    newest = for_account(log, uid).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return newest.select(
        "action", "description", "patient_id", "fraud_type", "amount", tx.age_label(F.col("created_at"), as_of).alias("ago")
    )


def latest_upload(sessions: DataFrame) -> DataFrame:
    """Time of the last upload as a date label, Never without one."""
    last = F.date_format(F.max("uploaded_at"), "dd MMM yyyy")
    return sessions.agg(F.coalesce(last, F.lit("Never")).alias("last_updated"))


def case_cards(cases: DataFrame) -> DataFrame:
    """The display columns of each case."""
    return cases.select(
        tx.one_line(F.col("PatientID")).alias("PatientID"),
        tx.one_line(F.col("Primary_Diagnosis")).alias("Primary_Diagnosis"),
        F.concat(F.coalesce(F.col("Age").cast("string"), F.lit("—")), F.lit(" yrs")).alias("Age_Label"),
        tx.rupees(F.coalesce("Final_Billed_Amount", F.lit(0.0))).alias("Amount_Label"),
        F.concat(truncated_percent(F.col("Risk_Score")).cast("string"), F.lit("% RISK")).alias("Risk_Label"),
        F.col("Fraud_Type"),
        tx.one_line(F.col("AI_Justification")).alias("AI_Justification"),
    )

