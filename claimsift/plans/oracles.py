"""DuckDB SQL for the registered queries, over the same whole tables.

Written against the tables, not against the Spark code: shared parts are common
table expressions that each statement puts in front.
"""

from __future__ import annotations

from claimsift.functions import risk, text as tx
from claimsift.plans.catalog import ACCOUNT, EARLIER, LATE, LIMIT, NOW, PERIOD, SWEEP, TREE_SWEEP
from claimsift.schema import CONTAMINATION, SEED, TREES

ORACLES: dict[str, str] = {}

CLAIMS = """
claims AS MATERIALIZED (
  SELECT concat('T', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS TransactionID,
         concat('P', l_orderkey, '-', l_linenumber) AS PatientID,
         l_suppkey AS Hospital_PIN,
         cast(20 + o_custkey % 70 AS int) AS Age,
         CASE WHEN o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
         CASE WHEN p_type = 'ECONOMY' THEN 'Maternity Care' ELSE p_type END AS Primary_Diagnosis,
         l_extendedprice AS Final_Billed_Amount,
         CASE WHEN l_partkey % 40 = 0 THEN cast(0 AS double) ELSE p_retailprice * l_quantity * 2 END AS Base_Package_Rate,
         o_orderdate + to_hours(cast(l_linenumber * 3 AS int)) AS Admission_Timestamp,
         o_orderdate + to_hours(cast(l_linenumber * 3 + (l_partkey % 12) * 24 + l_suppkey % 24 - 12 AS int)) AS Discharge_Timestamp,
         o_orderdate - to_days(cast(l_suppkey % 5 AS int)) AS PreAuth_Request_Date,
         CASE WHEN l_tax = 0 THEN NULL
              ELSE o_orderdate - to_days(cast(l_suppkey % 5 AS int)) + to_days(cast(l_partkey % 4 AS int)) END AS PreAuth_Approval_Date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

SESSIONS = """
sessions AS (
  SELECT event_id AS id, cast(user_id AS varchar) AS uid, cast(user_id AS varchar) AS user_id,
         concat('batch_', event_id, '.csv') AS filename,
         k AS total_rows, k - k % 3 AS new_rows, k % 3 AS skipped_rows, k % 7 AS fraud_detected,
         value AS suspicious_amt, ts AS uploaded_at
  FROM (SELECT *, cast(json_extract_string(props, '$.k') AS int) AS k FROM events))"""

LOG = """
log AS (
  SELECT event_id AS id, cast(user_id AS varchar) AS uid, cast(user_id AS varchar) AS user_id, event_type AS action,
         concat('event ', event_id) AS description, '' AS patient_id, '' AS fraud_type, value AS amount, ts AS created_at
  FROM events)"""

FEATURES = f"""{CLAIMS},
hospital AS (
  SELECT Hospital_PIN,
         cast(sum(cast(Final_Billed_Amount AS decimal(28, 6))) AS double) / count(Final_Billed_Amount) AS Hospital_Avg_Cost
  FROM claims GROUP BY 1),
patient AS (
  SELECT PatientID, count(TransactionID) AS Patient_Claim_Count, count(DISTINCT Hospital_PIN) AS Hospitals
  FROM claims GROUP BY 1),
features AS MATERIALIZED (
  SELECT c.*, h.Hospital_Avg_Cost, p.Patient_Claim_Count, p.Hospitals,
         cast(floor((epoch_us(Discharge_Timestamp) - epoch_us(Admission_Timestamp)) / 86400000000) AS bigint) AS LOS,
         cast(floor((epoch_us(PreAuth_Approval_Date) - epoch_us(PreAuth_Request_Date)) / 86400000000) AS bigint) AS PreAuth_Delay,
         Final_Billed_Amount / CASE WHEN Base_Package_Rate = 0 THEN cast(1 AS double) ELSE Base_Package_Rate END AS Cost_to_Package
  FROM claims c LEFT JOIN hospital h USING (Hospital_PIN) LEFT JOIN patient p USING (PatientID))"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def template(text: str, words: dict[str, str]) -> str:
    """A template with {name} slots as SQL concat."""
    parts = []
    for part in text.replace("}", "{").split("{"):
        if part:
            parts.append(words.get(part) or quoted(part))
    return f"concat({', '.join(parts)})"


def rules(profile: str) -> dict[str, str]:
    found = {"zero_rate": "Base_Package_Rate = 0", "ratio": "Cost_to_Package > 2.5", "stay": "LOS <= 0"}
    if profile == "app":
        found["gender"] = "(Gender = 'Male' AND Primary_Diagnosis = 'Maternity Care')"
    else:
        found["many_hospitals"] = "Hospitals > 1"
    return found


def rupees(value: str) -> str:
    return f"concat('₹', format('{{:,.0f}}', {value}))"


def fmt_amount(value: str) -> str:
    return (
        f"CASE WHEN {value} >= 10000000 THEN concat('₹', format('{{:.1f}}', {value} / 10000000), ' Cr') "
        f"WHEN {value} >= 100000 THEN concat('₹', format('{{:.1f}}', {value} / 100000), ' L') ELSE {rupees(value)} END"
    )


def ruled(profile: str) -> str:
    """Features with Rule_Fraud, rule names and fraud type."""
    found = rules(profile)
    names = ", ".join(f"CASE WHEN coalesce({p}, false) THEN '{n}' END" for n, p in found.items())
    anyone = " OR ".join(f"coalesce({p}, false)" for p in found.values())
    return f"""{FEATURES},
ruled AS (
  SELECT *, cast({anyone} AS int) AS Rule_Fraud, concat_ws(',', {names}) AS Rules,
         CASE WHEN Base_Package_Rate = 0 THEN 'Ghost Billing' WHEN Cost_to_Package > 2.5 THEN '{risk.UPCODING[profile]}'
              WHEN Patient_Claim_Count > 2 THEN 'Identity Misuse' WHEN LOS <= 0 THEN 'Fake Admission'
              ELSE 'Anomalous Pattern' END AS Fraud_Type
  FROM features)"""


def fused(profile: str) -> str:
    score = (
        "Rule_Fraud * cast(0.5 AS double) + cast(ML_Anomaly = -1 AS int) * cast(0.4 AS double) "
        "+ cast(coalesce(Cost_to_Package > 2, false) AS int) * cast(0.1 AS double)"
    )
    return f"round({score}, 2)" if profile == "app" else score


WORDS = {
    "amount": rupees("Final_Billed_Amount"),
    "hospital": "Hospital_PIN",
    "patient": "PatientID",
    "age": "Age",
    "diagnosis": "Primary_Diagnosis",
    "stay": "LOS",
    "ratio": "concat(format('{:.1f}', Cost_to_Package), 'x')",
    "risk": "format('{:.2f}', Risk_Score)",
}


def verdicts(profile: str = "app", model: str = "1", source: str = "ruled", before: str | None = None) -> str:
    """Every claim with its verdict; ``model`` is the SQL of ML_Anomaly."""
    cases = " ".join(f"WHEN Fraud_Type = '{k}' THEN {template(t, WORDS)}" for k, t in risk.TEMPLATES.items())
    text = f"CASE {cases} END" if profile == "app" else quoted(risk.NO_MODEL_TEXT)
    return f"""{before or ruled(profile)},
labelled AS (SELECT *, {model} AS ML_Anomaly FROM {source}),
risky AS (SELECT *, {fused(profile)} AS Risk_Score FROM labelled),
flags AS (SELECT *, cast(Risk_Score > 0.5 AS int) AS Fraud_Flag,
                 cast(round(Risk_Score * 100, 0) AS int) AS Suspicion_Score FROM risky),
verdicts AS (SELECT *, CASE WHEN Fraud_Flag = 1 THEN {text} ELSE '' END AS AI_Justification FROM flags)"""


CASES = f"""{verdicts()},
cases AS (
  SELECT PatientID, Age, Primary_Diagnosis, Final_Billed_Amount, Fraud_Type, AI_Justification, Risk_Score
  FROM verdicts WHERE Fraud_Flag = 1
  QUALIFY row_number() OVER (PARTITION BY PatientID ORDER BY Risk_Score DESC, TransactionID, Final_Billed_Amount) = 1)"""


def oracle(name: str, before: str, select: str) -> None:
    ORACLES[name] = (f"WITH {before}\n" if before else "") + select


def money(value: str) -> str:
    return f"coalesce(cast(sum(cast({value} AS decimal(28, 6))) AS double), 0)"


# --- Sources and sinks ------------------------------------------------------

STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
TIMES = ["Admission_Timestamp", "Discharge_Timestamp", "PreAuth_Request_Date", "PreAuth_Approval_Date"]

oracle(
    "s01_read_claims_csv",
    CLAIMS,
    # A file's cells are texts; hospital ids stay so.
    f"SELECT * REPLACE (cast(Hospital_PIN AS varchar) AS Hospital_PIN, {', '.join(STAMP.format(c) + ' AS ' + c for c in TIMES)}) FROM claims",
)
oracle(
    "s02_read_table",
    SESSIONS,
    "SELECT cast(id AS varchar) AS id, nullif(user_id, '') AS user_id, filename, cast(total_rows AS bigint) AS total_rows, "
    f"suspicious_amt FROM sessions WHERE user_id = '{ACCOUNT}'",
)
oracle("s03_load_first_nonempty", CLAIMS, "SELECT TransactionID, Final_Billed_Amount FROM claims")

STORED = f"""{CLAIMS},
stored AS (
  SELECT *, CASE WHEN Admission_Timestamp < timestamp '{EARLIER}' THEN '2023-01-01' ELSE '{NOW[:10]}' END AS uploaded
  FROM claims
  QUALIFY row_number() OVER (PARTITION BY PatientID ORDER BY Admission_Timestamp >= timestamp '{EARLIER}', TransactionID, Final_Billed_Amount) = 1)"""

oracle(
    "s01_rejected_cells",
    CLAIMS,
    """SELECT TransactionID, 'Age' AS column_name, 'old' AS cell FROM claims WHERE Hospital_PIN % 7 = 0
UNION ALL SELECT TransactionID, 'Final_Billed_Amount', concat('Rs ', Age) FROM claims WHERE Age % 9 = 0
UNION ALL SELECT TransactionID, 'Admission_Timestamp', 'soon' FROM claims WHERE Age % 11 = 0
UNION ALL SELECT TransactionID, '(line)', NULL FROM claims WHERE Age % 13 = 0""",
)
oracle(
    "s01_intake_report",
    f"""{CLAIMS},
parts AS (
  SELECT 'Age' AS column_name, count(*) FILTER (Hospital_PIN % 7 <> 1) AS cells, count(*) FILTER (Hospital_PIN % 7 = 0) AS rejected FROM claims
  UNION ALL SELECT 'Final_Billed_Amount', count(*), count(*) FILTER (Age % 9 = 0) FROM claims
  UNION ALL SELECT 'Admission_Timestamp', count(*), count(*) FILTER (Age % 11 = 0) FROM claims
  UNION ALL SELECT '(line)', count(*), count(*) FILTER (Age % 13 = 0) FROM claims)""",
    "SELECT column_name, cells, cells - rejected AS accepted, rejected FROM parts",
)
oracle(
    "s04_append_new",
    STORED,
    "SELECT PatientID, Age, Final_Billed_Amount, cast(0 AS int) AS Fraud_Flag, uploaded FROM stored",
)
oracle(
    "s04_append_counts",
    f"""{CLAIMS},
known AS (SELECT DISTINCT PatientID FROM claims WHERE Admission_Timestamp < timestamp '{EARLIER}'),
per AS (SELECT PatientID, count(*) AS n, PatientID IN (SELECT PatientID FROM known) AS old FROM claims GROUP BY 1)""",
    """SELECT cast(sum(n) AS bigint) AS total, count(*) FILTER (NOT old) AS new,
cast(coalesce(sum(n) FILTER (old), 0) AS bigint) AS skipped,
cast(coalesce(sum(n - 1) FILTER (NOT old), 0) AS bigint) AS in_batch_duplicates, cast(0 AS bigint) AS null_keys FROM per""",
)
oracle(
    "s04_append_by_claim",
    CLAIMS,
    f"""SELECT TransactionID, PatientID, Age, Final_Billed_Amount,
CASE WHEN Admission_Timestamp < timestamp '{EARLIER}' THEN '2023-01-01' ELSE '{NOW[:10]}' END AS uploaded FROM claims
QUALIFY row_number() OVER (PARTITION BY TransactionID ORDER BY Admission_Timestamp >= timestamp '{EARLIER}', PatientID, Age, Final_Billed_Amount) = 1""",
)
FLAGGED_ONE = """
best AS (
  SELECT * FROM verdicts WHERE Fraud_Flag = 1
  QUALIFY row_number() OVER (PARTITION BY PatientID ORDER BY Risk_Score DESC, TransactionID, Final_Billed_Amount) = 1)"""
oracle(
    "s05_upsert",
    f"{verdicts()},{STORED.split(CLAIMS + ',')[1]},{FLAGGED_ONE}",
    """SELECT s.PatientID, s.Age, coalesce(b.Final_Billed_Amount, s.Final_Billed_Amount) AS Final_Billed_Amount,
coalesce(b.Fraud_Flag, 0) AS Fraud_Flag, coalesce(b.Fraud_Type, '') AS Fraud_Type, coalesce(b.Risk_Score, 0) AS Risk_Score,
s.uploaded FROM stored s LEFT JOIN best b USING (PatientID)""",
)
oracle(
    "s06_upsert_detected_frauds",
    CASES,
    "SELECT PatientID, Age, Primary_Diagnosis, Final_Billed_Amount, Fraud_Type, Risk_Score, 'analyst' AS user_id, "
    f"'{NOW[:10]}' AS detected FROM cases",
)
oracle(
    "s07_log_upload_sessions",
    SESSIONS,
    "SELECT cast(id AS varchar) AS id, uid, CASE WHEN length(uid) > 20 THEN uid END AS user_id, filename, "
    "cast(total_rows AS bigint) AS total_rows, cast(new_rows AS bigint) AS new_rows, "
    f"cast(skipped_rows AS bigint) AS skipped_rows, '{NOW[:10]}' AS uploaded FROM sessions",
)
oracle(
    "s08_log_audit_events",
    LOG,
    "SELECT cast(id AS varchar) AS id, uid, action, description, patient_id, fraud_type, "
    "CASE WHEN action = 'error' THEN 0 ELSE amount END AS amount FROM log",
)
oracle(
    "s09_update_claim_status",
    f"""{CASES},
updates AS (SELECT DISTINCT PatientID, CASE WHEN Age < 50 THEN 'Cleared' ELSE 'Frozen' END AS status FROM claims WHERE Gender = 'Male'),
known AS (SELECT DISTINCT PatientID FROM claims WHERE Admission_Timestamp < timestamp '{EARLIER}')""",
    """SELECT 'claims' AS part, PatientID, coalesce(status, '-') AS status FROM known LEFT JOIN updates USING (PatientID)
UNION ALL SELECT 'detected_frauds', PatientID, coalesce(status, '-') FROM cases LEFT JOIN updates USING (PatientID)
UNION ALL SELECT 'audit_log', PatientID, concat('Status for Patient ', PatientID, ' changed to ''', status, '''.') FROM updates""",
)
DROPPED = r"[^\x00-\x7F\x{0900}-\x{097F}\x{20B9}]"
oracle(
    "s10_export_audit_csv",
    "",
    rf"""SELECT doc_id, lang, md5(nullif(regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '{DROPPED}', '', 'g'), '')) AS text_md5
FROM documents""",
)
oracle(
    "s11_sanitize_for_sink",
    CLAIMS,
    """SELECT TransactionID, strftime(Admission_Timestamp, '%Y-%m-%dT%H:%M:%S') AS Admission_Timestamp,
strftime(PreAuth_Approval_Date, '%Y-%m-%dT%H:%M:%S') AS PreAuth_Approval_Date,
nullif(Base_Package_Rate, 0) AS Base_Package_Rate,
CASE WHEN Gender <> 'Male' THEN Final_Billed_Amount END AS Final_Billed_Amount FROM claims""",
)
oracle(
    "s12_sync_csv",
    f"{CLAIMS},\nn AS (SELECT count(DISTINCT PatientID) AS keys, count(*) AS total FROM claims)",
    """SELECT keys AS stored, concat('✅ Sync Complete: ', keys, ' new rows added, 0 skipped.') AS first_sync,
concat('✅ Sync Complete: 0 new rows added, ', total, ' skipped.') AS second_sync, true AS ok FROM n""",
)
oracle(
    "s12_sync_by_claim",
    f"{CLAIMS},\nn AS (SELECT count(DISTINCT TransactionID) AS keys, count(*) AS total FROM claims)",
    """SELECT keys AS stored, concat('✅ Sync Complete: ', keys, ' new rows added, 0 skipped.') AS first_sync,
concat('✅ Sync Complete: 0 new rows added, ', total, ' skipped.') AS second_sync, true AS ok FROM n""",
)
REPORT = "TransactionID, PatientID, Hospital_PIN, Fraud_Type, Final_Billed_Amount, Risk_Score, AI_Justification"
oracle("s13_fraud_report", verdicts("batch"), f"SELECT {REPORT} FROM verdicts WHERE Fraud_Flag = 1")
oracle("s14_read_detected_frauds", CASES, "SELECT PatientID, Risk_Score, Fraud_Type FROM cases ORDER BY Risk_Score DESC, PatientID")
oracle(
    "s15_insert_defaults",
    CLAIMS,
    f"""SELECT PatientID, Age, CASE WHEN Gender = 'Male' THEN Primary_Diagnosis ELSE '' END AS Primary_Diagnosis,
'Anomalous' AS Fraud_Type, '' AS AI_Justification, cast(0 AS double) AS Risk_Score, '{NOW[:10]}' AS detected FROM claims""",
)

# --- Projections ------------------------------------------------------------

oracle(
    "p01_parse_timestamps",
    CLAIMS,
    f"""SELECT TransactionID, CASE WHEN Gender = 'Male' THEN {STAMP.format('Admission_Timestamp')} END AS Admission_Timestamp,
{', '.join(f"{STAMP.format(c)} AS {c}" for c in ('Discharge_Timestamp', 'PreAuth_Request_Date', 'PreAuth_Approval_Date'))} FROM claims""",
)
oracle(
    "p01_layout_report",
    CLAIMS,
    """SELECT 'Admission_Timestamp' AS time_column, 'd/M/yyyy' AS layout, count(*) AS cells,
count(*) FILTER (Gender = 'Male') AS read, count(*) FILTER (Gender <> 'Male') AS misfits FROM claims
UNION ALL SELECT 'Discharge_Timestamp', 'M/d/yyyy', count(*), count(*), 0 FROM claims
UNION ALL SELECT 'PreAuth_Request_Date', 'd MMM yyyy', count(*), count(*), 0 FROM claims
UNION ALL SELECT 'PreAuth_Approval_Date', 'ISO', count(PreAuth_Approval_Date), count(PreAuth_Approval_Date), 0 FROM claims""",
)
for name, column in [("p02_los", "LOS"), ("p03_preauth_delay", "PreAuth_Delay"), ("p04_cost_to_package", "Cost_to_Package")]:
    oracle(name, FEATURES, f"SELECT TransactionID, {column} FROM features")
oracle("p05_resolve_cost_col", CLAIMS, "SELECT TransactionID, 'TreatmentCost' AS cost_column, Final_Billed_Amount AS cost FROM claims")
oracle(
    "p06_normalize_defaults",
    CLAIMS,
    """SELECT PatientID, Final_Billed_Amount, Age, cast(1 AS bigint) AS LOS, cast(0 AS bigint) AS PreAuth_Delay,
cast(1 AS double) AS Cost_to_Package, Final_Billed_Amount AS Hospital_Avg_Cost, cast(1 AS bigint) AS Patient_Claim_Count FROM claims""",
)
VALUES = ["Final_Billed_Amount", "Cost_to_Package", "LOS", "PreAuth_Delay", "Hospital_Avg_Cost", "Patient_Claim_Count", "Age"]
FILLED = [f"coalesce(cast({c} AS double), 0)" for c in VALUES]
oracle(
    "p07_feature_values",
    FEATURES,
    f"SELECT TransactionID, {', '.join(f'{v} AS {c}' for v, c in zip(FILLED, VALUES))} FROM features",
)
oracle("p08_to_fraud_schema", CLAIMS, "SELECT TransactionID, Final_Billed_Amount, Primary_Diagnosis FROM claims")
oracle("p09_stamp_user", CLAIMS, "SELECT TransactionID, 'analyst' AS user_id FROM claims")
oracle("p10_suspicion_score", verdicts(), 'SELECT TransactionID, Suspicion_Score, Risk_Score AS "Risk score per claim" FROM verdicts')
oracle(
    "p11_select_existing",
    verdicts(),
    "SELECT PatientID, Age, Primary_Diagnosis, Final_Billed_Amount, Fraud_Type, AI_Justification, Risk_Score FROM verdicts",
)

# --- Filters ----------------------------------------------------------------

for name, predicate, columns in [
    ("f01_rule_zero_rate", rules("app")["zero_rate"], "Base_Package_Rate"),
    ("f02_rule_ratio", rules("app")["ratio"], "Cost_to_Package"),
    ("f03_rule_stay", rules("app")["stay"], "LOS"),
    ("f04_rule_gender", rules("app")["gender"], "Gender, Primary_Diagnosis"),
    ("f05_rule_many_hospitals", rules("batch")["many_hospitals"], "PatientID, Hospital_PIN"),
]:
    oracle(name, FEATURES, f"SELECT TransactionID, {columns} FROM features WHERE {predicate}")
for profile in ("app", "batch"):
    oracle(f"f06_rule_fraud_{profile}", ruled(profile), "SELECT TransactionID, Rule_Fraud, Rules FROM ruled")
oracle("f07_flagged", verdicts(), "SELECT TransactionID, Risk_Score, Fraud_Type FROM verdicts WHERE Fraud_Flag = 1")
oracle("f08_for_user", SESSIONS, f"SELECT * EXCLUDE (uploaded_at) FROM sessions WHERE user_id = '{ACCOUNT}'")
oracle(
    "f09_for_account",
    f"{LOG},\nguests AS (SELECT id, uid, CASE WHEN action <> 'view' THEN user_id END AS user_id, action FROM log)",
    f"SELECT * FROM guests WHERE user_id = '{ACCOUNT}' OR uid = '{ACCOUNT}'",
)

# --- Joins ------------------------------------------------------------------

oracle("j01_hospital_avg_cost", FEATURES, "SELECT TransactionID, Hospital_Avg_Cost FROM features")
oracle("j02_patient_claim_count", FEATURES, "SELECT TransactionID, Patient_Claim_Count FROM features")
oracle("j03_suspicious_patients", FEATURES, "SELECT TransactionID, Hospitals > 1 AS suspicious FROM features")
KNOWN = f"{CLAIMS},\nknown AS (SELECT DISTINCT PatientID FROM claims WHERE Admission_Timestamp < timestamp '{EARLIER}')"
oracle("j04_new_rows", KNOWN, "SELECT TransactionID, PatientID FROM claims WHERE PatientID NOT IN (SELECT PatientID FROM known)")
oracle("j05_skipped_rows", KNOWN, "SELECT TransactionID, PatientID FROM claims WHERE PatientID IN (SELECT PatientID FROM known)")

# --- Aggregations -----------------------------------------------------------

oracle("a01_mean_cost_per_hospital", FEATURES, "SELECT * FROM hospital")
oracle("a02_claims_per_patient", FEATURES, "SELECT PatientID, Patient_Claim_Count FROM patient")
oracle("a03_hospitals_per_patient", FEATURES, "SELECT PatientID, Hospitals FROM patient")
TYPES = "SELECT Fraud_Type, count(*) AS Counts FROM {0} GROUP BY 1 ORDER BY 2 DESC, 1"
oracle("a04_fraud_type_counts", verdicts(), TYPES.format("verdicts"))
oracle(
    "a05_batch_kpis",
    verdicts(),
    f"""SELECT count(*) AS Total_Rows, count(*) FILTER (Fraud_Flag = 1) AS Fraud_Found,
round(count(*) FILTER (Fraud_Flag = 1) * cast(100 AS double) / nullif(count(*), 0), 1) AS Fraud_Percent,
{money("CASE WHEN Fraud_Flag = 1 THEN Final_Billed_Amount END")} AS Suspicious FROM verdicts""",
)
STATS = """SELECT (SELECT count(*) FROM verdicts {0}) AS total_claims,
(SELECT count(*) FILTER (Fraud_Flag = 1) FROM verdicts {0}) AS total_fraud,
(SELECT {1} FROM verdicts {0}) AS suspicious_amt,
(SELECT coalesce(strftime(max(uploaded_at), '%d %b %Y'), 'Never') FROM sessions {2}) AS last_updated,
(SELECT count(*) FROM sessions {2}) AS total_uploads"""
HIT = money("CASE WHEN Fraud_Flag = 1 THEN Final_Billed_Amount END")
oracle("a06_db_stats", f"{verdicts()},{SESSIONS}", STATS.format("", HIT, ""))
oracle(
    "a06_db_stats_of_user",
    f"{verdicts()},{SESSIONS}",
    STATS.format(f"WHERE cast(Age AS varchar) = '{ACCOUNT}'", HIT, f"WHERE user_id = '{ACCOUNT}'"),
)
oracle(
    "a07_user_activity",
    SESSIONS,
    "SELECT cast(coalesce(sum(total_rows), 0) AS bigint) AS total_claims, cast(coalesce(sum(fraud_detected), 0) AS bigint) AS total_frauds "
    f"FROM sessions WHERE user_id = '{ACCOUNT}' OR uid = '{ACCOUNT}'",
)
oracle(
    "a07_activity_by_user",
    SESSIONS,
    "SELECT user_id AS account, cast(sum(total_rows) AS bigint) AS total_claims, cast(sum(fraud_detected) AS bigint) AS total_frauds "
    "FROM sessions WHERE user_id IS NOT NULL GROUP BY 1",
)
TREND = """SELECT strftime(uploaded_at, '%Y-%m-%d') AS Date, cast(sum(fraud_detected) AS bigint) AS Flagged,
cast(sum(total_rows) AS bigint) AS Total FROM {0} GROUP BY 1 ORDER BY 1"""
NEWEST = "newest AS (SELECT * FROM sessions ORDER BY uploaded_at DESC, id DESC LIMIT 100)"
oracle("a08_daily_trend", f"{SESSIONS},\n{NEWEST}", TREND.format("newest"))
oracle("a08_daily_trend_whole", SESSIONS, TREND.format("sessions"))
oracle(
    "a08_daily_trend_n_days",
    f"""{SESSIONS},
late AS (SELECT * FROM sessions WHERE cast(uploaded_at AS date) > (SELECT max(cast(uploaded_at AS date)) FROM sessions) - 7)""",
    TREND.format("late"),
)
SUMMARY = f"""SELECT count(*) AS Cases, {money("Final_Billed_Amount")} AS Total_Amount,
{fmt_amount(money("Final_Billed_Amount"))} AS Total_Label,
cast(trunc(cast(sum(cast(Risk_Score AS decimal(18, 4))) AS double) / nullif(count(Risk_Score), 0) * 100) AS int) AS Avg_Risk_Percent
FROM cases"""
oracle("a09_audit_summary", CASES, SUMMARY)
oracle(
    "a10_dataset_counts",
    verdicts(),
    "SELECT count(*) AS n_rows, cast(coalesce(sum(Fraud_Flag), 0) AS bigint) AS n_fraud FROM verdicts",
)

# --- Sequences --------------------------------------------------------------


def replay(keys: str, limit: int, period: int, columns: str) -> str:
    """The limiter as a recursion over the events of each key in time order."""
    return f"""WITH RECURSIVE {LOG},
ordered AS MATERIALIZED (
  SELECT *, epoch_us(created_at) AS t, row_number() OVER (PARTITION BY {keys} ORDER BY created_at, id) AS rn FROM log),
steps AS (
  SELECT {keys}, id, rn, true AS allowed, [t] AS held FROM ordered WHERE rn = 1
  UNION ALL
  SELECT {', '.join('o.' + k.strip() for k in keys.split(','))}, o.id, o.rn,
         len(list_filter(s.held, lambda x: o.t - x < {period * 1_000_000})) < {limit},
         CASE WHEN len(list_filter(s.held, lambda x: o.t - x < {period * 1_000_000})) < {limit}
              THEN list_append(list_filter(s.held, lambda x: o.t - x < {period * 1_000_000}), o.t)
              ELSE list_filter(s.held, lambda x: o.t - x < {period * 1_000_000}) END
  FROM steps s JOIN ordered o ON {' AND '.join(f'o.{k.strip()} = s.{k.strip()}' for k in keys.split(','))} AND o.rn = s.rn + 1)
SELECT {columns} FROM steps"""


ORACLES["w01_rate_limit_replay"] = replay("uid", LIMIT, PERIOD, "id, uid, allowed")
ORACLES["w01_rate_limit_by_action"] = replay("uid, action", 1, 86400, "id, allowed")
oracle(
    "w02_chat_context",
    """lines AS (
  SELECT conv_id, turn, concat(CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END, ': ', text) AS line,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations)""",
    """SELECT a.conv_id, a.turn, count(*) AS n, string_agg(b.line, chr(10) ORDER BY b.rn) AS context
FROM lines a JOIN lines b ON a.conv_id = b.conv_id AND b.rn BETWEEN a.rn - 5 AND a.rn GROUP BY a.conv_id, a.turn, a.rn""",
)

# --- Sorts and limits -------------------------------------------------------

QUEUE = "FROM cases ORDER BY Risk_Score DESC, PatientID"
oracle("t01_fraud_queue", CASES, f"SELECT PatientID, Risk_Score, Fraud_Type {QUEUE}")
oracle("t02_top_alerts", CASES, f"SELECT PatientID, Fraud_Type {QUEUE} LIMIT 3")
oracle("t02_top_cases", CASES, f"SELECT PatientID, Fraud_Type, Risk_Score, Final_Billed_Amount {QUEUE} LIMIT 5")
HISTORY = """SELECT id, filename, total_rows, strftime(uploaded_at, '%d %b %Y, %I:%M %p') AS date_label
FROM sessions {0} ORDER BY uploaded_at DESC, id DESC LIMIT 10"""
oracle("t03_upload_history", SESSIONS, HISTORY.format(f"WHERE uid = '{ACCOUNT}'"))
oracle("t03_upload_history_all", SESSIONS, HISTORY.format(""))


def ago(then: str, now: str) -> str:
    seconds = f"cast(trunc((epoch_us(timestamp '{now}') - epoch_us({then})) / 1000000) AS bigint)"
    return (
        f"CASE WHEN {then} IS NULL THEN 'JUST NOW' WHEN {seconds} < 60 THEN concat({seconds}, 'S AGO') "
        f"WHEN {seconds} < 3600 THEN concat({seconds} // 60, 'M AGO') "
        f"WHEN {seconds} < 86400 THEN concat({seconds} // 3600, 'H AGO') ELSE concat({seconds} // 86400, 'D AGO') END"
    )


oracle(
    "t04_recent_audit",
    LOG,
    f"""SELECT action, description, patient_id, fraud_type, amount, {ago("created_at", NOW)} AS ago FROM log
WHERE user_id = '{ACCOUNT}' OR uid = '{ACCOUNT}' ORDER BY created_at DESC, id DESC LIMIT 20""",
)
oracle("t05_latest_upload", SESSIONS, "SELECT coalesce(strftime(max(uploaded_at), '%d %b %Y'), 'Never') AS last_updated FROM sessions")
oracle("t06_newest_sessions", f"{SESSIONS},\n{NEWEST}", "SELECT id, total_rows, fraud_detected FROM newest")

# --- Set operations ---------------------------------------------------------

oracle(
    "u01_partition_batch",
    KNOWN,
    "SELECT TransactionID, CASE WHEN PatientID IN (SELECT PatientID FROM known) THEN 'skipped' ELSE 'new' END AS part FROM claims",
)
oracle(
    "u02_keyed_union",
    CASES,
    """SELECT PatientID, 'incoming' AS origin, Risk_Score FROM cases
UNION ALL SELECT DISTINCT PatientID, 'stored', NULL FROM claims WHERE PatientID NOT IN (SELECT PatientID FROM cases)""",
)

# --- Scalar functions -------------------------------------------------------

oracle(
    "x01_fmt_amount",
    f"{CLAIMS},\nscaled AS (SELECT TransactionID, Final_Billed_Amount * pow(cast(10 AS double), Hospital_PIN % 6 - 2) AS v FROM claims)",
    f"SELECT TransactionID, {fmt_amount('v')} AS label FROM scaled",
)
oracle(
    "x02_number_texts",
    verdicts(),
    f"SELECT TransactionID, {WORDS['amount']} AS amount, {WORDS['ratio']} AS ratio, {WORDS['risk']} AS risk FROM verdicts",
)
oracle("x03_strip_symbols", "", f"SELECT doc_id, regexp_replace(text, '{DROPPED}', '', 'g') AS text FROM documents")
oracle(
    "x04_one_line",
    "",
    rf"SELECT doc_id, replace(regexp_replace(text, '^{tx.SPACES}+|{tx.SPACES}+\z', '', 'g'), chr(10), ' ') AS text FROM documents",
)
EVENT_TEXT = "CASE WHEN event_type = 'error' THEN concat('at ', strftime(ts, '%Y-%m-%dT%H:%M:%S')) END"
oracle(
    "x05_date_label",
    "",
    f"SELECT event_id, coalesce(left({EVENT_TEXT}, 10), strftime(ts, '%d %b %Y')) AS label FROM events",
)
oracle(
    "x06_datetime_label",
    "",
    f"SELECT event_id, coalesce(left({EVENT_TEXT}, 16), strftime(ts, '%d %b %Y, %I:%M %p')) AS label FROM events",
)
oracle(
    "x07_age_label",
    "seen AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN ts END AS created FROM events)",
    f"SELECT event_id, {ago('created', '2024-01-30 23:59:30')} AS ago FROM seen",
)
oracle(
    "x08_keyword_reply",
    f"{CASES},\nopen AS (SELECT count(*) AS n FROM cases)",
    f"""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'ghost') THEN {quoted(tx.GHOST_REPLY)}
WHEN contains(lower(text), 'upcode') THEN {quoted(tx.UPCODE_REPLY)}
WHEN contains(lower(text), 'data') THEN concat('Currently, I see ', (SELECT n FROM open), ' critical cases in the cloud database.')
ELSE concat('Forensic DB indicates ', (SELECT n FROM open),
            ' investigations pending. Configure OpenAI or use specific keywords.') END AS reply FROM conversations""",
)
oracle(
    "x09_display_name",
    "names AS (SELECT c_custkey, lower(split_part(concat(replace(c_name, '#', '.'), 'x_ray@audit.example.org'), '@', 1)) AS name FROM customer)",
    r"""SELECT c_custkey, list_aggregate(list_transform(regexp_extract_all(name, '[a-z]+|[^a-z]+'),
lambda p: concat(upper(left(p, 1)), substr(p, 2))), 'string_agg', '') AS name FROM names""",
)
oracle(
    "x10_short_texts",
    "",
    "SELECT s_suppkey, left(s_name, 8) AS short, upper(left(lower(s_name), 1)) AS initial FROM supplier",
)
oracle("x11_fraud_type", ruled("batch"), "SELECT TransactionID, Fraud_Type FROM ruled")
oracle("x12_justification", verdicts(), "SELECT TransactionID, AI_Justification FROM verdicts")
oracle(
    "x13_llm_prompt",
    verdicts("batch"),
    "SELECT TransactionID, "
    + template(
        risk.PROMPT,
        {
            "age": "Age",
            "diagnosis": "Primary_Diagnosis",
            "cost": "format('{}', Final_Billed_Amount)",
            "rate": "format('{}', Base_Package_Rate)",
            "stay": "LOS",
            "kind": "Fraud_Type",
        },
    )
    + " AS prompt FROM verdicts WHERE Fraud_Flag = 1",
)
oracle(
    "x14_risk_tier",
    verdicts(),
    "SELECT TransactionID, CASE WHEN Suspicion_Score >= 70 THEN 'High Risk' WHEN Suspicion_Score >= 40 THEN 'Investigating' "
    "ELSE 'Safe' END AS tier FROM verdicts",
)
MODE = "CASE WHEN {0} < 0.08 THEN 'Conservative' WHEN {0} < 0.16 THEN 'Balanced' ELSE 'Aggressive' END"
oracle(
    "x15_sensitivity_label",
    "",
    f"SELECT l_orderkey, l_linenumber, l_discount, {MODE.format('l_discount * 2')} AS mode FROM lineitem",
)
oracle("x16_user_id_of", "", "SELECT page_id, CASE WHEN length(url) > 20 THEN url END AS user_id FROM pages")
oracle(
    "x17_fallback_justification",
    verdicts(),
    f"""SELECT TransactionID, CASE WHEN AI_Justification = '' THEN concat({WORDS['amount']}, ' flagged — ', Fraud_Type,
'. Risk: ', {WORDS['risk']}, '. Manual review needed.') ELSE AI_Justification END AS text FROM verdicts""",
)
oracle("x18_truncated_percent", "", "SELECT l_orderkey, l_linenumber, l_tax, cast(trunc(l_tax * 100) AS int) AS percent FROM lineitem")

# --- Model ------------------------------------------------------------------
# The forest in SQL: the same draws, one level of all trees per statement part.

ROWS, LEVELS = 256, 8


def drawn(*parts: str) -> str:
    """A number in [0, 1) from md5 of the parts joined by '|'."""
    text = ", '|', ".join(parts)
    return f"cast(cast(concat('0x', substr(md5(concat({text})), 1, 8)) AS bigint) AS double) / cast(4294967296 AS double)"


def samples() -> str:
    return f"""{FEATURES},
numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, [{', '.join(FILLED)}] AS x FROM features),
alike AS (
  SELECT *, row_number() OVER (
    PARTITION BY TransactionID ORDER BY Final_Billed_Amount, Base_Package_Rate, Admission_Timestamp, PreAuth_Approval_Date NULLS FIRST) AS n
  FROM numbered),
apart AS (SELECT CASE WHEN n = 1 THEN TransactionID ELSE concat(TransactionID, '|', n) END AS id, x FROM alike),
pool AS MATERIALIZED (SELECT id, x FROM apart ORDER BY md5(concat('{SEED}|0|', id)), id LIMIT {TREES * ROWS}),
size AS (SELECT count(*) AS m, least({ROWS}, count(*)) AS psi FROM pool),
deal AS (SELECT m, psi, greatest(1, least({TREES}, m // greatest(psi, 1))) AS per_lap FROM size),
laps AS (SELECT unnest(range(cast(ceil({TREES} / per_lap) AS bigint))) AS lap FROM deal),
ranked AS (
  SELECT id, x, lap, row_number() OVER (PARTITION BY lap ORDER BY md5(concat('{SEED}|', lap, '|', id)), id) - 1 AS r FROM pool, laps),
dealt AS MATERIALIZED (
  SELECT cast(lap * per_lap + r // psi AS int) AS tree, id, x FROM ranked, deal
  WHERE r < per_lap * psi AND lap * per_lap + r // psi < {TREES}),
depths AS (SELECT cast(ceil(log2(greatest(psi, 2))) AS int) AS deepest FROM deal)"""


def grown() -> str:
    """All nodes: per level the extents, the split, and the rows sent on."""
    parts = [samples(), "rows0 AS MATERIALIZED (SELECT tree, 1 AS node, x FROM dealt)"]
    low = ", ".join(f"min(x[{i}])" for i in range(1, 8))
    high = ", ".join(f"max(x[{i}])" for i in range(1, 8))
    mean = (
        "CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 * (ln(cast(n AS double) - 1) + cast(0.5772156649 AS double)) "
        "- 2 * (cast(n AS double) - 1) / n END"
    )
    for level in range(LEVELS + 1):
        parts.append(
            f"""extent{level} AS (SELECT tree, node, count(*) AS n, [{low}] AS lo, [{high}] AS hi FROM rows{level} GROUP BY 1, 2),
vary{level} AS (SELECT *, list_filter(range(1, 8), lambda i: lo[i] < hi[i]) AS open FROM extent{level}),
pick{level} AS (
  SELECT *, CASE WHEN n > 1 AND len(open) > 0 AND {level} < (SELECT deepest FROM depths)
    THEN open[1 + cast(floor({drawn(str(SEED), 'tree', 'node', "'f'")} * len(open)) AS int)] END AS f FROM vary{level}),
split{level} AS (
  SELECT *, lo[f] + {drawn(str(SEED), 'tree', 'node', "'t'")} * (hi[f] - lo[f]) AS raw FROM pick{level}),
nodes{level} AS MATERIALIZED (
  SELECT tree, cast(node AS int) AS node, cast(f - 1 AS int) AS feature, CASE WHEN raw >= hi[f] THEN lo[f] ELSE raw END AS threshold,
         cast(n AS int) AS rows,
         CASE WHEN f IS NULL THEN {level} * 1000 + cast(round(({mean}) * 1000) AS bigint) END AS path_milli
  FROM split{level})"""
        )
        if level < LEVELS:
            parts.append(
                f"""rows{level + 1} AS MATERIALIZED (
  SELECT r.tree, 2 * r.node + CASE WHEN r.x[n.feature + 1] <= n.threshold THEN 0 ELSE 1 END AS node, r.x
  FROM rows{level} r JOIN nodes{level} n ON r.tree = n.tree AND r.node = n.node WHERE n.feature IS NOT NULL)"""
            )
    union = " UNION ALL ".join(f"SELECT * FROM nodes{level}" for level in range(LEVELS + 1))
    parts.append(f"forest AS MATERIALIZED ({union})")
    return ",\n".join(parts)


def scored() -> str:
    """Walk every claim down every tree, level by level, until its leaf."""
    parts = [grown(), f"walk0 AS MATERIALIZED (SELECT rid, tree, 1 AS node FROM numbered, range({TREES}) t(tree))"]
    for level in range(LEVELS):
        parts.append(
            f"""walk{level + 1} AS MATERIALIZED (
  SELECT w.rid, w.tree, 2 * w.node + CASE WHEN v.x[n.feature + 1] <= n.threshold THEN 0 ELSE 1 END AS node
  FROM walk{level} w JOIN nodes{level} n ON w.tree = n.tree AND w.node = n.node JOIN numbered v ON v.rid = w.rid
  WHERE n.feature IS NOT NULL)"""
        )
    ends = " UNION ALL ".join(
        f"SELECT w.rid, w.tree, n.path_milli FROM walk{level} w JOIN nodes{level} n ON w.tree = n.tree AND w.node = n.node WHERE n.feature IS NULL"
        for level in range(LEVELS + 1)
    )
    parts.append(
        f"""ends AS MATERIALIZED ({ends}),
paths AS MATERIALIZED (
  SELECT rid, any_value(TransactionID) AS TransactionID, cast(sum(path_milli) AS bigint) AS Path_Sum
  FROM ends JOIN numbered USING (rid) GROUP BY rid),
expected AS (SELECT 2 * (ln(cast(psi AS double) - 1) + cast(0.5772156649 AS double)) - 2 * (cast(psi AS double) - 1) / psi AS c FROM deal),
cuts AS (
  SELECT c AS Contamination, sums[1 + cast(ceil((len(sums) - 1) * c) AS bigint)] AS Path_Cut
  FROM (VALUES (cast({CONTAMINATION} AS double))) v(c), (SELECT list(Path_Sum ORDER BY Path_Sum) AS sums FROM paths)),
modelled AS (
  SELECT f.*, p.Path_Sum, CASE WHEN p.Path_Sum < (SELECT Path_Cut FROM cuts) THEN -1 ELSE 1 END AS ML
  FROM numbered f JOIN paths p USING (rid))"""
    )
    return ",\n".join(parts)


def modelled_verdicts(profile: str) -> str:
    inner = ruled(profile).split("ruled AS")[1].replace("FROM features", "FROM modelled")
    return verdicts(profile, "ML", before=f"{scored()},\nruled AS{inner}")


oracle("m01_tree_samples", samples(), "SELECT tree, id AS TransactionID FROM dealt")
oracle("m02_fit_forest", grown(), "SELECT * FROM forest")
oracle(
    "m03_score_claims",
    scored(),
    f"""SELECT TransactionID, Path_Sum,
round(pow(cast(2 AS double), -(Path_Sum / cast({1000 * TREES} AS double)) / (SELECT c FROM expected)), 6) AS Anomaly_Score FROM paths""",
)
oracle("m04_anomaly_label", scored(), "SELECT TransactionID, cast(ML AS int) AS ML_Anomaly FROM modelled")
YOUNG = "CASE WHEN Age < 40 THEN -1 ELSE 1 END"
oracle("m05_risk_score", verdicts("app", YOUNG), "SELECT TransactionID, Risk_Score FROM verdicts")
oracle("m06_fraud_flag", verdicts("batch", YOUNG), "SELECT TransactionID, Fraud_Flag FROM verdicts")


def sweep() -> str:
    many = scored().replace(f"(VALUES (cast({CONTAMINATION} AS double)))", f"(VALUES {', '.join(f'(cast({c} AS double))' for c in SWEEP)})")
    many = many.replace("SELECT Path_Cut FROM cuts", f"SELECT Path_Cut FROM cuts WHERE Contamination = cast({CONTAMINATION} AS double)")
    inner = ruled("batch").split("ruled AS")[1].replace("FROM features", "FROM modelled")
    return f"""{many},
ruled AS{inner},
labelled AS (
  SELECT Contamination, Rule_Fraud, Cost_to_Package, CASE WHEN Path_Sum < Path_Cut THEN -1 ELSE 1 END AS ML_Anomaly FROM ruled, cuts),
judged AS (SELECT *, cast({fused('batch')} > 0.5 AS int) AS Fraud_Flag FROM labelled)"""


oracle(
    "m07_contamination_sweep",
    sweep(),
    f"""SELECT Contamination, count(*) AS Claims, count(*) FILTER (ML_Anomaly = -1) AS Anomalies,
count(*) FILTER (Fraud_Flag = 1) AS Flagged, {MODE.format('Contamination')} AS Sensitivity FROM judged GROUP BY Contamination""",
)



def tree_sweep() -> str:
    inner = ruled("batch").split("ruled AS")[1].replace("FROM features", "FROM modelled")
    return f"""{scored()},
ruled AS{inner},
first AS (
  SELECT cast(t AS int) AS Trees, rid, sum(path_milli) AS Sum
  FROM ends JOIN (VALUES {', '.join(f'({n})' for n in TREE_SWEEP)}) v(t) ON tree < t GROUP BY 1, 2),
limits AS (
  SELECT Trees, cast(c AS double) AS Contamination, sums[1 + cast(ceil((len(sums) - 1) * cast(c AS double)) AS bigint)] AS Cut
  FROM (VALUES {', '.join(f'({c})' for c in SWEEP)}) v(c), (SELECT Trees, list(Sum ORDER BY Sum) AS sums FROM first GROUP BY 1)),
labelled AS (
  SELECT Trees, Contamination, Rule_Fraud, Cost_to_Package, CASE WHEN Sum < Cut THEN -1 ELSE 1 END AS ML_Anomaly
  FROM first JOIN limits USING (Trees) JOIN ruled USING (rid)),
judged AS (SELECT *, cast({fused('batch')} > 0.5 AS int) AS Fraud_Flag FROM labelled)"""


oracle(
    "m07_trees_sweep",
    tree_sweep(),
    f"""SELECT Trees, Contamination, count(*) AS Claims, count(*) FILTER (ML_Anomaly = -1) AS Anomalies,
count(*) FILTER (Fraud_Flag = 1) AS Flagged, {MODE.format('Contamination')} AS Sensitivity FROM judged GROUP BY Trees, Contamination""",
)

# --- Streams ----------------------------------------------------------------

oracle("r01_ingest_stream", CLAIMS, "SELECT DISTINCT PatientID FROM claims")
oracle("r01_ingest_by_claim", CLAIMS, "SELECT DISTINCT TransactionID, PatientID FROM claims")
oracle(
    "r01_ingest_counts",
    f"""{CLAIMS},
per AS (
  SELECT PatientID, count(*) FILTER (Admission_Timestamp < timestamp '{EARLIER}') AS before,
         count(*) FILTER (Admission_Timestamp >= timestamp '{EARLIER}') AS after FROM claims GROUP BY 1)""",
    """SELECT 'ingest-0' AS batch_id, cast(sum(before) AS bigint) AS total, count(*) FILTER (before > 0) AS new, cast(0 AS bigint) AS skipped,
cast(sum(before - 1) FILTER (before > 0) AS bigint) AS in_batch_duplicates, cast(0 AS bigint) AS null_keys FROM per
UNION ALL SELECT 'ingest-1', cast(sum(after) AS bigint), count(*) FILTER (before = 0),
cast(coalesce(sum(after) FILTER (before > 0), 0) AS bigint), cast(coalesce(sum(after - 1) FILTER (before = 0), 0) AS bigint), 0 FROM per""",
)
oracle(
    "r02_daily_session_kpis",
    f"""{SESSIONS},
closed AS (
  SELECT * FROM sessions
  WHERE cast(uploaded_at AS date) + INTERVAL 1 DAY <= (SELECT max(uploaded_at) FROM sessions) - INTERVAL 1 DAY)""",
    TREND.format("closed"),
)
# What the watermark, a bound behind the newest event, has passed by the millisecond.
ORACLES["r03_limited_stream"] = (
    replay("uid", LIMIT, PERIOD, "id, uid, allowed")
    + f" JOIN (SELECT id, t FROM ordered) USING (id) WHERE t < ((SELECT max(t) FROM ordered) // 1000 - {LATE * 1000}) * 1000"
)
oracle(
    "r04_scored_stream",
    modelled_verdicts("batch"),
    "SELECT TransactionID, cast(ML_Anomaly AS int) AS ML_Anomaly, Risk_Score, Fraud_Flag, Fraud_Type FROM verdicts",
)

# --- End to end -------------------------------------------------------------

oracle("e01_audit_report", modelled_verdicts("batch"), f"SELECT {REPORT} FROM verdicts WHERE Fraud_Flag = 1")
oracle("e01_rules_only_report", verdicts(), f"SELECT {REPORT} FROM verdicts WHERE Fraud_Flag = 1")
oracle(
    "e03_queue_context",
    f"""{CASES},
summary AS ({SUMMARY}),
kinds AS (SELECT Fraud_Type, count(*) AS n FROM cases GROUP BY 1),
best AS (SELECT * {QUEUE} LIMIT 5)""",
    f"""SELECT Cases, CASE WHEN Cases = 0 THEN 'You are the forensic auditor. No fraud cases in queue.' ELSE
concat('You are the forensic auditor. The current audit queue has ', Cases, ' cases with a total suspicious value of ', Total_Label,
'. Common patterns: {{', (SELECT string_agg(concat('''', Fraud_Type, ''': ', n), ', ' ORDER BY n DESC, Fraud_Type) FROM kinds),
'}}. Top cases: [', (SELECT string_agg(concat(PatientID, ' ', Fraud_Type, ' ', {rupees("Final_Billed_Amount")}), '; '
ORDER BY Risk_Score DESC, PatientID) FROM best), ']. Answer accurately and clinically.') END AS Context FROM summary""",
)
oracle("e04_audit_page_summary", CASES, SUMMARY)
oracle("e04_audit_page_types", CASES, TYPES.format("cases"))
oracle(
    "e04_audit_page_cards",
    CASES,
    f"""SELECT PatientID, Primary_Diagnosis, concat(Age, ' yrs') AS Age_Label, {rupees("Final_Billed_Amount")} AS Amount_Label,
concat(cast(trunc(Risk_Score * 100) AS int), '% RISK') AS Risk_Label, Fraud_Type, AI_Justification FROM cases""",
)


def upload(earlier_only: bool) -> str:
    """One upload's verdicts: the app profile with the model fitted on that batch."""
    text = modelled_verdicts("app")
    app_order = [FILLED[i] for i in (0, 2, 1, 3, 4, 5, 6)]
    text = text.replace(", ".join(FILLED), ", ".join(app_order))
    if earlier_only:
        admitted = "o_orderdate + to_hours(cast(l_linenumber * 3 AS int))"
        text = text.replace("ON l_partkey = p_partkey)", f"ON l_partkey = p_partkey WHERE {admitted} < timestamp '{EARLIER}')")
    return f"(WITH {text}\nSELECT TransactionID, PatientID, Fraud_Flag, Final_Billed_Amount FROM verdicts)"


def upload_row(number: int, filename: str, known: str) -> str:
    """The session row of an upload; ``known`` counts the claims stored before it."""
    batch = f"u{number}"
    return f"""SELECT '{batch}' AS id, '{filename}' AS filename, count(*) AS total_rows,
count(DISTINCT TransactionID) - ({known}) AS new_rows,
count(*) FILTER (TransactionID IN (SELECT TransactionID FROM stored{number})) AS skipped_rows,
count(*) FILTER (Fraud_Flag = 1) AS fraud_detected, {HIT.replace('verdicts', batch)} AS suspicious_amt,
(SELECT count(DISTINCT TransactionID) FROM u2) AS claims_stored,
(SELECT count(*) FROM (SELECT PatientID FROM u1 WHERE Fraud_Flag = 1 UNION SELECT PatientID FROM u2 WHERE Fraud_Flag = 1)) AS cases_stored,
cast(2 AS bigint) AS log_entries FROM {batch}"""


oracle(
    "e02_process_upload",
    f"""u1 AS MATERIALIZED {upload(True)},
u2 AS MATERIALIZED {upload(False)},
stored1 AS (SELECT TransactionID FROM u1 WHERE false),
stored2 AS (SELECT DISTINCT TransactionID FROM u1)""",
    upload_row(1, "first.csv", "SELECT 0")
    + "\nUNION ALL "
    + upload_row(2, "second.csv", "SELECT count(*) FROM stored2"),
)
