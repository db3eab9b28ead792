"""Every registered query: (spark, folder of the test tables) to a frame.

Keys start with the operator's id in the survey. Each query reads whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from claimsift.functions import risk, text as tx, values as vl
from claimsift.operators import context, features as ft, forest as fo, keyed, replay, summaries as sm
from claimsift.plans import audit as au
from claimsift.schema import FRAUD_COLUMNS, REPORT_COLUMNS
from claimsift.session import COMPRESSION, materialize, shared_folder
from claimsift.sources import files, fixtures as fx, tables as tb
from claimsift.streaming import ingest, kpis, limiter, scoring

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# The claims that count as stored already when a query needs an earlier state.
EARLIER = "1998-01-01"
ACCOUNT = "41"
SWEEP = [0.01, 0.05, 0.08, 0.12, 0.16, 0.2, 0.3]
TREE_SWEEP = [50, 100, 200]
LIMIT, PERIOD = 3, 2 * 86400
LATE = 86400


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


NOW = "2024-02-01 00:00:00"


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def typed(spark: SparkSession, sf: str, stored: bool = False, columns: list[str] | None = None) -> DataFrame:
    return ft.typed_claims(fx.claims(spark, sf, stored, columns))


def verdicts(spark: SparkSession, sf: str, profile: str = "app") -> DataFrame:
    return au.rules_only(fx.claims(spark, sf), profile)


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Detected frauds: flagged claims, the riskiest one of each patient."""
    found = tb.select_existing(sm.flagged(verdicts(spark, sf)), [*FRAUD_COLUMNS, "TransactionID"])
    return keyed.one_per_key(found, "PatientID", keyed.riskiest_claim(found)).drop("_key", "_copies", "TransactionID")


def earlier(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("Admission_Timestamp") < moment(EARLIER))



def result_claims(claims: DataFrame) -> DataFrame:
    return sm.flagged(au.rules_only(claims))


# --- Sources and sinks ------------------------------------------------------


@query
def s01_read_claims_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "csv")
    stamp = "yyyy-MM-dd HH:mm:ss"
    claims = fx.claims(spark, sf)
    texts = {c: F.date_format(c, stamp) for c in ft.TIME_COLUMNS}
    claims.withColumns(texts).write.csv(path, header=True)
    back = files.read_claims_csv(spark, path)
    return back.withColumns({c: F.date_format(c, stamp) for c in ft.TIME_COLUMNS})


def flawed_file(spark: SparkSession, sf: str) -> files.CheckedClaims:
    """Claims written to a file with cells that fit no type and lines with a cell too many."""
    claims, path = fx.claims(spark, sf), folder(spark, "csv")
    age = F.when(F.col("Hospital_PIN") % 7 == 0, F.lit("old")).when(F.col("Hospital_PIN") % 7 == 1, F.lit("n/a")).otherwise(F.col("Age").cast("string"))
    cost = F.when(F.col("Age") % 9 == 0, F.concat(F.lit("Rs "), F.col("Age"))).otherwise(F.col("Final_Billed_Amount").cast("string"))
    admitted = F.when(F.col("Age") % 11 == 0, F.lit("soon")).otherwise(F.date_format("Admission_Timestamp", "dd/MM/yyyy"))
    note = F.when(F.col("Age") % 13 == 0, F.lit("see, there")).otherwise(F.lit("-"))
    rows = claims.select("TransactionID", age.alias("Age"), cost.alias("Final_Billed_Amount"), admitted.alias("Admission_Timestamp"), note.alias("Note"))
    # Without quotes the comma of a note begins another cell.
    rows.write.csv(path, header=True, quote="")
    return files.check_claims_csv(spark, path)


@query
def s01_rejected_cells(spark: SparkSession, sf: str) -> DataFrame:
    rejects = flawed_file(spark, sf).rejects
    cell = F.when(F.col("column_name") != files.LINE, F.col("cell"))
    return rejects.select(F.get_json_object("row", "$.TransactionID").alias("TransactionID"), "column_name", cell.alias("cell"))


@query
def s01_intake_report(spark: SparkSession, sf: str) -> DataFrame:
    return flawed_file(spark, sf).report


@query
def s02_read_table(spark: SparkSession, sf: str) -> DataFrame:
    store = tb.ClaimStore(spark, folder(spark, "store"), claim_key="PatientID")
    store.append("upload_sessions", tb.session_rows(fx.upload_sessions(spark, sf), moment(NOW)))
    return store.read("upload_sessions", ACCOUNT).select("id", "user_id", "filename", "total_rows", "suspicious_amt")


@query
def s03_load_first_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    store = tb.ClaimStore(spark, folder(spark, "store"), claim_key="PatientID")
    missing = f"{shared_folder(spark)}/no-such-file.parquet"
    loaded = files.load_first_nonempty(
        [lambda: spark.read.parquet(missing), lambda: store.read("claims"), lambda: fx.claims(spark, sf)]
    )
    return loaded.select("TransactionID", "Final_Billed_Amount")


def appended(spark: SparkSession, claims: DataFrame) -> tb.ClaimStore:
    store = tb.ClaimStore(spark, folder(spark, "store"), claim_key="PatientID")
    store.append_new("claims", earlier(claims), moment("2023-01-01 00:00:00"))
    store.append_new("claims", claims, moment(NOW))
    return store


@query
def s04_append_new(spark: SparkSession, sf: str) -> DataFrame:
    store = appended(spark, typed(spark, sf, stored=True))
    return store.read("claims").select(
        "PatientID", "Age", "Final_Billed_Amount", "Fraud_Flag", day("uploaded_at").alias("uploaded")
    )


@query
def s04_append_counts(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf)
    target = earlier(claims).select("PatientID")
    reduced = keyed.one_per_key(claims.select("PatientID", "TransactionID"), "PatientID", keyed.first_claim(claims))
    return keyed.intake_counts(keyed.mark_known(reduced, target, "PatientID"))


@query
def s04_append_by_claim(spark: SparkSession, sf: str) -> DataFrame:
    store = tb.ClaimStore(spark, folder(spark, "store"))
    wanted = ["TransactionID", "PatientID", "Age", "Final_Billed_Amount", "Admission_Timestamp"]
    claims = typed(spark, sf, stored=True, columns=wanted)
    store.append_new("claims", earlier(claims), moment("2023-01-01 00:00:00"), stored=True)
    store.append_new("claims", claims, moment(NOW), stored=True)
    return store.read("claims").select("TransactionID", "PatientID", "Age", "Final_Billed_Amount", day("uploaded_at").alias("uploaded"))


@query
def s05_upsert(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf, stored=True)
    store = appended(spark, claims)
    store.upsert("claims", result_claims(claims).drop("Age"), moment(NOW))
    return store.read("claims").select(
        "PatientID", "Age", "Final_Billed_Amount", "Fraud_Flag", "Fraud_Type", "Risk_Score", day("uploaded_at").alias("uploaded")
    )


def stored_cases(spark: SparkSession, claims: DataFrame, user: str | None = "analyst") -> tb.ClaimStore:
    store = tb.ClaimStore(spark, folder(spark, "store"), claim_key="PatientID")
    found = result_claims(claims)
    store.upsert_detected_frauds(found, moment(NOW), "Final_Billed_Amount", user)
    return store


@query
def s06_upsert_detected_frauds(spark: SparkSession, sf: str) -> DataFrame:
    return stored_cases(spark, fx.claims(spark, sf)).read("detected_frauds").select(
        "PatientID",
        "Age",
        "Primary_Diagnosis",
        "Final_Billed_Amount",
        "Fraud_Type",
        "Risk_Score",
        "user_id",
        day("detected_at").alias("detected"),
    )


@query
def s07_log_upload_sessions(spark: SparkSession, sf: str) -> DataFrame:
    store = tb.ClaimStore(spark, folder(spark, "store"), claim_key="PatientID")
    sessions = fx.upload_sessions(spark, sf).drop("user_id", "uploaded_at")
    store.log_upload_sessions(sessions, moment(NOW))
    store.log_upload_sessions(sessions, moment(NOW))
    return store.read("upload_sessions").select(
        "id", "uid", "user_id", "filename", "total_rows", "new_rows", "skipped_rows", day("uploaded_at").alias("uploaded")
    )


@query
def s08_log_audit_events(spark: SparkSession, sf: str) -> DataFrame:
    store = tb.ClaimStore(spark, folder(spark, "store"), claim_key="PatientID")
    events = fx.audit_log(spark, sf).drop("user_id", "patient_id").withColumn(
        "amount", F.when(F.col("action") != "error", F.col("amount"))
    )
    store.log_audit_events(events, moment(NOW))
    return store.read("audit_log").select("id", "uid", "action", "description", "patient_id", "fraud_type", "amount")


@query
def s09_update_claim_status(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf, stored=True)
    store = stored_cases(spark, claims)
    store.append_new("claims", earlier(claims), moment(NOW))
    updates = claims.where(F.col("Gender") == "Male").select(
        "PatientID", F.when(F.col("Age") < 50, F.lit("Cleared")).otherwise(F.lit("Frozen")).alias("Investigation_Status")
    )
    store.update_claim_status(updates.distinct(), moment(NOW), "batch-1", "analyst")

    def listed(table: str) -> DataFrame:
        return store.read(table).select(F.lit(table).alias("part"), "PatientID", F.coalesce("Investigation_Status", F.lit("-")).alias("status"))

    log = store.read("audit_log").select(F.lit("audit_log").alias("part"), F.col("patient_id").alias("PatientID"), F.col("description").alias("status"))
    return listed("claims").unionAll(listed("detected_frauds")).unionAll(log)


@query
def s10_export_audit_csv(spark: SparkSession, sf: str) -> DataFrame:
    documents = fx.table(spark, sf, "documents").select("doc_id", "lang", "source", F.length("text").alias("chars"), "text")
    path = files.export_audit_csv(
        documents.withColumn("text", F.regexp_replace("text", "[\r\n]", " ")), folder(spark, "export"), datetime(2024, 2, 1, 9, 30)
    )
    back = spark.read.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return back.select(F.col("doc_id").cast("long"), "lang", F.md5("text").alias("text_md5"))


@query
def s11_sanitize_for_sink(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf).select(
        "TransactionID",
        "Admission_Timestamp",
        "PreAuth_Approval_Date",
        F.when(F.col("Base_Package_Rate") == 0, F.lit(float("inf"))).otherwise(F.col("Base_Package_Rate")).alias("Base_Package_Rate"),
        F.when(F.col("Gender") == "Male", F.lit(float("nan"))).otherwise(F.col("Final_Billed_Amount")).alias("Final_Billed_Amount"),
    )
    return files.sanitize_for_sink(claims)


def synced_twice(spark: SparkSession, sf: str, key: str) -> DataFrame:
    path = folder(spark, "csv")
    typed(spark, sf).select("PatientID", "Age", "Final_Billed_Amount", "TransactionID").write.csv(path, header=True)
    store = tb.ClaimStore(spark, folder(spark, "store"), claim_key=key)
    done, message = store.sync_csv(path, moment(NOW))
    again, second = store.sync_csv(path, moment(NOW))
    return store.read("claims").agg(
        F.count(F.lit(1)).alias("stored"),
        F.lit(message).alias("first_sync"),
        F.lit(second).alias("second_sync"),
        F.lit(done and again).alias("ok"),
    )


@query
def s12_sync_csv(spark: SparkSession, sf: str) -> DataFrame:
    return synced_twice(spark, sf, "PatientID")


@query
def s12_sync_by_claim(spark: SparkSession, sf: str) -> DataFrame:
    return synced_twice(spark, sf, "TransactionID")


@query
def s13_fraud_report(spark: SparkSession, sf: str) -> DataFrame:
    return au.fraud_report(verdicts(spark, sf, "batch"))


@query
def s14_read_detected_frauds(spark: SparkSession, sf: str) -> DataFrame:
    queue = stored_cases(spark, fx.claims(spark, sf)).read_detected_frauds("analyst")
    return queue.select("PatientID", "Risk_Score", "Fraud_Type")


@query
def s15_insert_defaults(spark: SparkSession, sf: str) -> DataFrame:
    found = typed(spark, sf).select(
        "PatientID", "Age", F.when(F.col("Gender") == "Male", F.col("Primary_Diagnosis")).alias("Primary_Diagnosis")
    )
    rows = tb.conform(found, tb.TABLES["detected_frauds"], tb.defaults_of("detected_frauds", moment(NOW)))
    return rows.select(
        "PatientID", "Age", "Primary_Diagnosis", "Fraud_Type", "AI_Justification", "Risk_Score", day("detected_at").alias("detected")
    )


# --- Projections ------------------------------------------------------------


def written_times(spark: SparkSession, sf: str) -> DataFrame:
    """Claims whose time columns are texts, each in a layout of its own."""
    admitted = F.date_format("Admission_Timestamp", "dd/MM/yyyy HH:mm")
    return fx.claims(spark, sf).select(
        "TransactionID",
        F.when(F.col("Gender") == "Male", admitted).otherwise(F.lit("not a date")).alias("Admission_Timestamp"),
        F.date_format("Discharge_Timestamp", "MM/dd/yyyy hh:mm a").alias("Discharge_Timestamp"),
        F.date_format("PreAuth_Request_Date", "d MMM yyyy").alias("PreAuth_Request_Date"),
        F.date_format("PreAuth_Approval_Date", "yyyy-MM-dd").alias("PreAuth_Approval_Date"),
    )


@query
def p01_parse_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    stamp = "yyyy-MM-dd HH:mm:ss"
    parsed = ft.parse_timestamps(written_times(spark, sf))
    return parsed.select("TransactionID", *[F.date_format(c, stamp).alias(c) for c in ft.TIME_COLUMNS])


@query
def p01_layout_report(spark: SparkSession, sf: str) -> DataFrame:
    return ft.layout_report(spark, ft.time_layouts(written_times(spark, sf)))


@query
def p02_los(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf)
    return claims.select("TransactionID", ft.los(claims).alias("LOS"))


@query
def p03_preauth_delay(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf)
    return claims.select("TransactionID", ft.preauth_delay(claims).alias("PreAuth_Delay"))


@query
def p04_cost_to_package(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf)
    return claims.select("TransactionID", ft.cost_to_package(claims).alias("Cost_to_Package"))


@query
def p05_resolve_cost_col(spark: SparkSession, sf: str) -> DataFrame:
    claims = fx.claims(spark, sf).withColumnRenamed("Final_Billed_Amount", "TreatmentCost")
    cost = ft.resolve_cost_col(claims)
    return claims.select("TransactionID", F.lit(cost).alias("cost_column"), F.col(cost).alias("cost"))


@query
def p06_normalize_defaults(spark: SparkSession, sf: str) -> DataFrame:
    bare = typed(spark, sf).select("PatientID", "Final_Billed_Amount", "Age")
    return ft.derive_features(bare).drop("Multi_Hospital")


@query
def p07_feature_values(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf, stored=True)
    featured = ft.derive_features(claims, ft.store_hospital_figures(claims))
    return featured.select("TransactionID", *ft.feature_values(ft.feature_columns(featured, "app")))


@query
def p08_to_fraud_schema(spark: SparkSession, sf: str) -> DataFrame:
    claims = (
        fx.claims(spark, sf)
        .withColumnRenamed("Final_Billed_Amount", "TreatmentCost")
        .withColumnRenamed("Primary_Diagnosis", "Disease")
    )
    mapped = tb.to_fraud_schema(claims, ft.resolve_cost_col(claims))
    return mapped.select("TransactionID", "Final_Billed_Amount", "Primary_Diagnosis")


@query
def p09_stamp_user(spark: SparkSession, sf: str) -> DataFrame:
    return tb.stamp_user(fx.claims(spark, sf), "analyst").select("TransactionID", "user_id")


@query
def p10_suspicion_score(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).select("TransactionID", "Suspicion_Score", "Risk score per claim")


@query
def p11_select_existing(spark: SparkSession, sf: str) -> DataFrame:
    return tb.select_existing(verdicts(spark, sf), tb.FRAUD_COLUMNS)


# --- Filters ----------------------------------------------------------------


def rule_query(name: str, predicate: Callable[[], Column], columns: list[str]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ratios = ft.claim_ratios(typed(spark, sf))
        return ratios.where(predicate()).select("TransactionID", *columns)

    run.__name__ = name
    query(run)


rule_query("f01_rule_zero_rate", risk.rule_zero_rate, ["Base_Package_Rate"])
rule_query("f02_rule_ratio", risk.rule_ratio, ["Cost_to_Package"])
rule_query("f03_rule_stay", risk.rule_stay, ["LOS"])
rule_query("f04_rule_gender", risk.rule_gender, ["Gender", "Primary_Diagnosis"])


@query
def f05_rule_many_hospitals(spark: SparkSession, sf: str) -> DataFrame:
    featured = ft.attach_patients(typed(spark, sf), ft.patient_figures(typed(spark, sf)))
    return featured.where(risk.rule_many_hospitals()).select("TransactionID", "PatientID", "Hospital_PIN")


@query
def f06_rule_fraud_app(spark: SparkSession, sf: str) -> DataFrame:
    ruled = au.ruled_claims(fx.claims(spark, sf), "app")
    return ruled.select("TransactionID", "Rule_Fraud", F.concat_ws(",", "Rules").alias("Rules"))


@query
def f06_rule_fraud_batch(spark: SparkSession, sf: str) -> DataFrame:
    ruled = au.ruled_claims(fx.claims(spark, sf), "batch")
    return ruled.select("TransactionID", "Rule_Fraud", F.concat_ws(",", "Rules").alias("Rules"))


@query
def f07_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return sm.flagged(verdicts(spark, sf)).select("TransactionID", "Risk_Score", "Fraud_Type")


@query
def f08_for_user(spark: SparkSession, sf: str) -> DataFrame:
    return sm.for_user(fx.upload_sessions(spark, sf), ACCOUNT).drop("uploaded_at")


@query
def f09_for_account(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.audit_log(spark, sf).withColumn("user_id", F.when(F.col("action") != "view", F.col("user_id")))
    return sm.for_account(log, ACCOUNT).select("id", "uid", "user_id", "action")


# --- Joins ------------------------------------------------------------------


@query
def j01_hospital_avg_cost(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf)
    return ft.attach_hospitals(claims, ft.store_hospital_figures(claims)).select("TransactionID", "Hospital_Avg_Cost")


@query
def j02_patient_claim_count(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf)
    return ft.attach_patients(claims, ft.patient_figures(claims)).select("TransactionID", "Patient_Claim_Count")


@query
def j03_suspicious_patients(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf)
    joined = ft.attach_patients(claims, ft.patient_figures(claims))
    return joined.select("TransactionID", vl.holds(F.col("Multi_Hospital")).alias("suspicious"))


@query
def j04_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf)
    return keyed.new_rows(claims, earlier(claims), "PatientID").select("TransactionID", "PatientID")


@query
def j05_skipped_rows(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf)
    return keyed.skipped_rows(claims, earlier(claims), "PatientID").select("TransactionID", "PatientID")


# --- Aggregations -----------------------------------------------------------


@query
def a01_mean_cost_per_hospital(spark: SparkSession, sf: str) -> DataFrame:
    return ft.hospital_figures(typed(spark, sf), "Final_Billed_Amount").drop("_rows")


@query
def a02_claims_per_patient(spark: SparkSession, sf: str) -> DataFrame:
    return ft.patient_figures(typed(spark, sf)).select("PatientID", "Patient_Claim_Count")


@query
def a03_hospitals_per_patient(spark: SparkSession, sf: str) -> DataFrame:
    return ft.hospitals_per_patient(typed(spark, sf))


@query
def a04_fraud_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sm.fraud_type_counts(verdicts(spark, sf))


@query
def a05_batch_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return sm.batch_kpis(verdicts(spark, sf), "Final_Billed_Amount")


@query
def a06_db_stats(spark: SparkSession, sf: str) -> DataFrame:
    return sm.db_stats(verdicts(spark, sf), fx.upload_sessions(spark, sf))


@query
def a06_db_stats_of_user(spark: SparkSession, sf: str) -> DataFrame:
    owned = verdicts(spark, sf).withColumn("user_id", F.col("Age").cast("string"))
    return sm.db_stats(owned, fx.upload_sessions(spark, sf), ACCOUNT)


@query
def a07_user_activity(spark: SparkSession, sf: str) -> DataFrame:
    return sm.user_activity(fx.upload_sessions(spark, sf), ACCOUNT)


@query
def a07_activity_by_user(spark: SparkSession, sf: str) -> DataFrame:
    return sm.activity_by_user(fx.upload_sessions(spark, sf))


@query
def a08_daily_trend(spark: SparkSession, sf: str) -> DataFrame:
    return sm.daily_trend(fx.upload_sessions(spark, sf), newest=100).withColumn("Date", day("Date"))


@query
def a08_daily_trend_whole(spark: SparkSession, sf: str) -> DataFrame:
    return sm.daily_trend(fx.upload_sessions(spark, sf), newest=None).withColumn("Date", day("Date"))


@query
def a08_daily_trend_n_days(spark: SparkSession, sf: str) -> DataFrame:
    return sm.daily_trend(fx.upload_sessions(spark, sf), n_days=7).withColumn("Date", day("Date"))


@query
def a09_audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sm.audit_summary(cases(spark, sf))


@query
def a10_dataset_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sm.dataset_counts(verdicts(spark, sf))


# --- Sequences --------------------------------------------------------------


@query
def w01_rate_limit_replay(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.audit_log(spark, sf).select("id", "uid", "created_at")
    return replay.rate_limit_replay(log, ["uid"], "created_at", "id", LIMIT, PERIOD).select("id", "uid", "allowed")


@query
def w01_rate_limit_by_action(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.audit_log(spark, sf).select("id", "uid", "action", "created_at")
    return replay.rate_limit_replay(log, ["uid", "action"], "created_at", "id", 1, 86400).select("id", "allowed")


@query
def w02_chat_context(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.transform("context", lambda m: F.concat_ws(": ", m.role, m.content))
    return context.chat_context(fx.table(spark, sf, "conversations")).select(
        "conv_id", "turn", F.size("context").cast("long").alias("n"), F.array_join(lines, "\n").alias("context")
    )


# --- Sorts and limits -------------------------------------------------------


@query
def t01_fraud_queue(spark: SparkSession, sf: str) -> DataFrame:
    return sm.fraud_queue(cases(spark, sf)).select("PatientID", "Risk_Score", "Fraud_Type")


@query
def t02_top_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return sm.top_cases(cases(spark, sf), 3).select("PatientID", "Fraud_Type")


@query
def t02_top_cases(spark: SparkSession, sf: str) -> DataFrame:
    return sm.top_cases(cases(spark, sf), 5).select("PatientID", "Fraud_Type", "Risk_Score", "Final_Billed_Amount")


@query
def t03_upload_history(spark: SparkSession, sf: str) -> DataFrame:
    return sm.upload_history(fx.upload_sessions(spark, sf), ACCOUNT).select("id", "filename", "total_rows", "date_label")


@query
def t03_upload_history_all(spark: SparkSession, sf: str) -> DataFrame:
    return sm.upload_history(fx.upload_sessions(spark, sf)).select("id", "filename", "total_rows", "date_label")


@query
def t04_recent_audit(spark: SparkSession, sf: str) -> DataFrame:
    return sm.recent_audit(fx.audit_log(spark, sf), ACCOUNT, moment(NOW))


@query
def t05_latest_upload(spark: SparkSession, sf: str) -> DataFrame:
    return sm.latest_upload(fx.upload_sessions(spark, sf))


@query
def t06_newest_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sm.newest_sessions(fx.upload_sessions(spark, sf)).select("id", "total_rows", "fraud_detected")


# --- Set operations ---------------------------------------------------------


@query
def u01_partition_batch(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf)
    marked = keyed.with_known(claims, earlier(claims), "PatientID")
    return marked.select("TransactionID", F.when(F.col("_known"), F.lit("skipped")).otherwise(F.lit("new")).alias("part"))


@query
def u02_keyed_union(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf, stored=True)
    one = keyed.one_per_key(claims.select("PatientID", "TransactionID"), "PatientID", keyed.first_claim(claims))
    stored = one.select("PatientID", F.lit("stored").alias("origin"))
    # What is read of the rows: figures that nobody asks for are not looked up, texts not carried.
    found = result_claims(claims).select("PatientID", "TransactionID", "Risk_Score")
    incoming = keyed.one_per_key(found, "PatientID", keyed.riskiest_claim(found)).select(
        "PatientID", F.lit("incoming").alias("origin"), "Risk_Score"
    )
    return keyed.keyed_union(stored, incoming, "PatientID")


# --- Scalar functions -------------------------------------------------------


@query
def x01_fmt_amount(spark: SparkSession, sf: str) -> DataFrame:
    scaled = F.col("Final_Billed_Amount") * F.pow(F.lit(10.0), F.col("Hospital_PIN") % 6 - 2)
    return typed(spark, sf).select("TransactionID", tx.fmt_amount(scaled).alias("label"))


@query
def x02_number_texts(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).select(
        "TransactionID",
        tx.rupees(F.col("Final_Billed_Amount")).alias("amount"),
        tx.times(F.col("Cost_to_Package")).alias("ratio"),
        tx.plain_number(F.col("Risk_Score"), 2).alias("risk"),
    )


@query
def x03_strip_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", tx.strip_symbols(F.col("text")).alias("text"))


@query
def x04_one_line(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", tx.one_line(F.col("text")).alias("text"))


def event_time_text() -> Column:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.col("event_type") == "error", F.concat(F.lit("at "), stamp)).otherwise(stamp)


@query
def x05_date_label(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "events").select("event_id", tx.date_label(event_time_text()).alias("label"))


@query
def x06_datetime_label(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "events").select("event_id", tx.datetime_label(event_time_text()).alias("label"))


@query
def x07_age_label(spark: SparkSession, sf: str) -> DataFrame:
    created = F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp"))
    latest = moment("2024-01-30 23:59:30")
    return fx.table(spark, sf, "events").select("event_id", tx.age_label(created, latest).alias("ago"))


@query
def x08_keyword_reply(spark: SparkSession, sf: str) -> DataFrame:
    open_cases = cases(spark, sf).agg(F.count(F.lit(1))).scalar()
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.keyword_reply(F.col("text"), open_cases).alias("reply")
    )


@query
def x09_display_name(spark: SparkSession, sf: str) -> DataFrame:
    email = F.concat(F.translate("c_name", "#", "."), F.lit("x_ray@audit.example.org"))
    return fx.table(spark, sf, "customer").select("c_custkey", tx.display_name(email).alias("name"))


@query
def x10_short_texts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "supplier").select(
        "s_suppkey", tx.short_id(F.col("s_name")).alias("short"), tx.initial(F.lower("s_name")).alias("initial")
    )


@query
def x11_fraud_type(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf, "batch").select("TransactionID", "Fraud_Type")


@query
def x12_justification(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).select("TransactionID", "AI_Justification")


@query
def x13_llm_prompt(spark: SparkSession, sf: str) -> DataFrame:
    report = sm.flagged(verdicts(spark, sf, "batch"))
    return report.select("TransactionID", risk.llm_prompt().alias("prompt"))


@query
def x14_risk_tier(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).select("TransactionID", risk.risk_tier(F.col("Suspicion_Score")).alias("tier"))


@query
def x15_sensitivity_label(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", risk.sensitivity_label(F.col("l_discount") * 2).alias("mode")
    )


@query
def x16_user_id_of(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "pages").select("page_id", tx.user_id_of(F.col("url")).alias("user_id"))


@query
def x17_fallback_justification(spark: SparkSession, sf: str) -> DataFrame:
    text = risk.fallback_justification(
        F.col("AI_Justification"), F.col("Final_Billed_Amount"), F.col("Fraud_Type"), F.col("Risk_Score")
    )
    return verdicts(spark, sf).select("TransactionID", text.alias("text"))


@query
def x18_truncated_percent(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_tax", vl.truncated_percent(F.col("l_tax")).alias("percent")
    )


# --- Model ------------------------------------------------------------------

BATCH = au.Settings(profile="batch")


@query
def m01_tree_samples(spark: SparkSession, sf: str) -> DataFrame:
    pool = fo.sample_pool(typed(spark, sf).select("TransactionID"), BATCH.trees * fo.TREE_ROWS, BATCH.seed)
    deal = fo.Deal(pool.count(), BATCH.trees)
    return fo.deal_rows(pool.select("_id"), deal, BATCH.seed).select("tree", F.col("_id").alias("TransactionID"))


@query
def m02_fit_forest(spark: SparkSession, sf: str) -> DataFrame:
    return au.fit(fx.claims(spark, sf, stored=True), BATCH).nodes


@query
def m03_score_claims(spark: SparkSession, sf: str) -> DataFrame:
    return au.scored_claims(fx.claims(spark, sf, stored=True), BATCH, ["TransactionID"], columns=["Path_Sum", "Anomaly_Score"]).select(
        "TransactionID", "Path_Sum", "Anomaly_Score"
    )


@query
def m04_anomaly_label(spark: SparkSession, sf: str) -> DataFrame:
    scored = au.scored_claims(fx.claims(spark, sf, stored=True), BATCH, ["TransactionID"], columns=["Path_Sum", "Anomaly_Score"])
    cut = fo.path_cut(scored, BATCH.contamination)
    return scored.select("TransactionID", fo.anomaly_label(cut).alias("ML_Anomaly"))


@query
def m05_risk_score(spark: SparkSession, sf: str) -> DataFrame:
    ruled = au.ruled_claims(fx.claims(spark, sf), "app")
    labelled = ruled.withColumn("ML_Anomaly", F.when(F.col("Age") < 40, F.lit(-1)).otherwise(F.lit(1)))
    return labelled.select("TransactionID", risk.risk_score("app").alias("Risk_Score"))


@query
def m06_fraud_flag(spark: SparkSession, sf: str) -> DataFrame:
    ruled = au.ruled_claims(fx.claims(spark, sf), "batch")
    labelled = ruled.withColumn("ML_Anomaly", F.when(F.col("Age") < 40, F.lit(-1)).otherwise(F.lit(1)))
    return labelled.withColumn("Risk_Score", risk.risk_score("batch")).select(
        "TransactionID", risk.fraud_flag().alias("Fraud_Flag")
    )


@query
def m07_contamination_sweep(spark: SparkSession, sf: str) -> DataFrame:
    scored = au.scored_claims(fx.claims(spark, sf, stored=True), BATCH, [], columns=au.SWEPT)
    return au.contamination_sweep(scored, SWEEP, "batch")


@query
def m07_trees_sweep(spark: SparkSession, sf: str) -> DataFrame:
    scored = au.scored_claims(fx.claims(spark, sf, stored=True), BATCH, [], trees=TREE_SWEEP, columns=[*au.SWEPT, "Path_Sums"])
    return au.settings_sweep(scored, TREE_SWEEP, SWEEP, "batch")


# --- Streams ----------------------------------------------------------------


def halves(df: DataFrame, time: str) -> list[DataFrame]:
    """The rows up to the median time, and those after it."""
    micros = F.unix_micros(time)
    middle = df.agg(F.percentile_approx(micros, 0.5)).first()[0]
    return [df.where(micros <= middle), df.where(micros > middle)]


def feed(pieces: list[DataFrame], label: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Let files arrive piece by piece and run the stream after each arrival.

    Every run starts the stream anew from its checkpoint.
    """
    spark = pieces[0].sparkSession
    path = folder(spark, label)
    for piece in pieces:
        piece.write.mode("append").option("compression", COMPRESSION).parquet(path)
        start(spark.readStream.schema(piece.schema).parquet(path)).awaitTermination()


def to_table(spark: SparkSession, build: Callable[[DataFrame], DataFrame]) -> tuple[str, Callable[[DataFrame], StreamingQuery]]:
    """A place for a stream's rows, and how to start the stream that fills it."""
    path, progress = folder(spark, "output"), folder(spark, "progress")

    def start(stream: DataFrame) -> StreamingQuery:
        writer = build(stream).writeStream.format("parquet").option("checkpointLocation", progress)
        return writer.trigger(availableNow=True).start(path)

    return path, start


def ingested(spark: SparkSession, sf: str, key: str, within: str | None = None) -> tb.ClaimStore:
    """A store into which the earlier claims and then the later ones were streamed."""
    claims = typed(spark, sf, stored=True).select("TransactionID", "PatientID", "Age", "Final_Billed_Amount", "Admission_Timestamp")
    store = tb.ClaimStore(spark, folder(spark, "store"), claim_key=key)
    progress = folder(spark, "progress")
    later = claims.where(F.col("Admission_Timestamp") >= moment(EARLIER))
    feed(
        [earlier(claims), later],
        "claims",
        lambda stream: ingest.ingest_stream(stream, store, moment(NOW), progress, within=within),
    )
    return store


@query
def r01_ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    return ingested(spark, sf, "PatientID").read("claims").select("PatientID")


@query
def r01_ingest_by_claim(spark: SparkSession, sf: str) -> DataFrame:
    return ingested(spark, sf, "TransactionID", "1 hour").read("claims").select("TransactionID", "PatientID")


@query
def r01_ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingested(spark, sf, "PatientID").read("ingest_batches").drop("ingested_at")


@query
def r02_daily_session_kpis(spark: SparkSession, sf: str) -> DataFrame:
    path, start = to_table(spark, kpis.daily_session_kpis)
    feed(halves(fx.upload_sessions(spark, sf), "uploaded_at"), "sessions", start)
    return spark.read.schema("Date date, Flagged long, Total long").parquet(path).withColumn("Date", day("Date"))


@query
def r03_limited_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events arrive up to a day late, in two files; the last day of them still waits."""
    log = fx.audit_log(spark, sf).select("id", "uid", "created_at")
    arrival = F.col("created_at") + F.make_dt_interval(secs=F.crc32(F.col("id").cast("string").cast("binary")) % LATE)
    middle = log.agg(F.percentile_approx(F.unix_micros("created_at"), 0.5)).first()[0]
    soon = F.unix_micros(arrival) <= middle
    path, start = to_table(spark, lambda stream: limiter.limited(stream, ["uid"], "created_at", "id", LIMIT, PERIOD, f"{LATE} seconds"))
    feed([log.where(soon), log.where(~soon)], "log", start)
    return spark.read.schema("id long, uid string, created_at timestamp, allowed boolean").parquet(path).drop("created_at")


@query
def r04_scored_stream(spark: SparkSession, sf: str) -> DataFrame:
    claims = typed(spark, sf, stored=True)
    saved = folder(spark, "forest")
    # Of the fit, the cut and the stream alike: made once.
    hospitals = ft.store_hospital_figures(claims)
    patients = materialize(ft.patient_figures(claims), "patients")
    forest = au.fit(claims, BATCH, hospitals)
    forest.save(saved)
    # The cut is read off the path sums alone.
    scored = au.scored_claims(claims, BATCH, [], forest, columns=["Path_Sum"], hospitals=hospitals, patients=patients)
    cut = fo.path_cut(scored, BATCH.contamination)
    loaded = fo.Forest.load(spark, saved)
    wanted = ["TransactionID", "ML_Anomaly", "Risk_Score", "Fraud_Flag", "Fraud_Type"]
    path, start = to_table(
        spark, lambda stream: scoring.scored_stream(stream, loaded, cut, hospitals, patients, "batch").select(*wanted)
    )
    feed(halves(claims, "Admission_Timestamp"), "claims", start)
    return spark.read.parquet(path)


# --- End to end -------------------------------------------------------------


@query
def e01_audit_report(spark: SparkSession, sf: str) -> DataFrame:
    return au.audit_report(fx.claims(spark, sf, stored=True))


@query
def e01_rules_only_report(spark: SparkSession, sf: str) -> DataFrame:
    return sm.flagged(verdicts(spark, sf)).select(*REPORT_COLUMNS)


@query
def e02_process_upload(spark: SparkSession, sf: str) -> DataFrame:
    store = tb.ClaimStore(spark, folder(spark, "store"), claim_key="TransactionID")
    claims = typed(spark, sf, stored=True)
    au.process_upload(store, earlier(claims), "u1", "first.csv", moment(NOW), "auditor", stored=True)
    au.process_upload(store, claims, "u2", "second.csv", moment(NOW), "auditor", stored=True)
    cases_left = store.read("detected_frauds").agg(F.count(F.lit(1))).scalar()
    logged = store.read("audit_log").agg(F.count(F.lit(1))).scalar()
    stored = store.read("claims").agg(F.count(F.lit(1))).scalar()
    return store.read("upload_sessions").select(
        "id",
        "filename",
        "total_rows",
        "new_rows",
        "skipped_rows",
        "fraud_detected",
        "suspicious_amt",
        stored.alias("claims_stored"),
        cases_left.alias("cases_stored"),
        logged.alias("log_entries"),
    )


@query
def e03_queue_context(spark: SparkSession, sf: str) -> DataFrame:
    return au.queue_context(cases(spark, sf))


@query
def e04_audit_page_summary(spark: SparkSession, sf: str) -> DataFrame:
    return au.audit_page(cases(spark, sf))["summary"]


@query
def e04_audit_page_types(spark: SparkSession, sf: str) -> DataFrame:
    return au.audit_page(cases(spark, sf))["types"]


@query
def e04_audit_page_cards(spark: SparkSession, sf: str) -> DataFrame:
    return au.audit_page(cases(spark, sf))["cards"]
