"""Stored tables, files and uploads."""

import json
import math
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from claimsift.operators import summaries as sm
from claimsift.plans import audit as au
from claimsift.schema import TABLES
from claimsift.session import shared_folder
from claimsift.sources import files, fixtures as fx, tables as tb
from claimsift.streaming import ingest

def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")



@pytest.fixture
def store(spark, tmp_path):
    return tb.ClaimStore(spark, str(tmp_path / "store"), claim_key="PatientID")


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "PatientID string, Age int, Final_Billed_Amount double")


def test_append_skips_known_keys_and_fills_defaults(spark, store):
    first = store.append_new("claims", people(spark, ("a", 1, 1.0), ("a", 2, 2.0), (None, 3, 3.0)), now(), user_id="u")
    assert first == {"total": 3, "new": 1, "skipped": 0, "in_batch_duplicates": 1, "null_keys": 1}
    second = store.append_new("claims", people(spark, ("a", 9, 9.0), ("b", 4, 4.0)), now())
    assert (second["new"], second["skipped"]) == (1, 1)
    rows = {r.PatientID: r for r in store.read("claims").collect()}
    assert rows["a"].Age == 1 and rows["a"].Fraud_Flag == 0 and rows["a"].Fraud_Type == "" and rows["a"].user_id == "u"
    assert rows["b"].uploaded_at == datetime(2024, 2, 1)
    assert store.read("claims", "u").count() == 1 and store.read("claims", "nobody").count() == 0


def test_upsert_keeps_absent_columns(spark, store):
    store.append_new("claims", people(spark, ("a", 1, 1.0), ("b", 2, 2.0)), now())
    results = spark.createDataFrame([("a", 1, 0.9), ("a", 1, 0.6), ("c", 0, 0.1)], "PatientID string, Fraud_Flag int, Risk_Score double")
    for _ in range(2):
        assert store.upsert("claims", results, now()) == 2
    rows = {r.PatientID: r for r in store.read("claims").collect()}
    assert len(rows) == 3 and store.read("claims").count() == 3
    assert (rows["a"].Age, rows["a"].Fraud_Flag, rows["a"].Risk_Score) == (1, 1, 0.9)
    assert rows["b"].Fraud_Flag == 0 and rows["c"].Fraud_Type == ""


def parts(store, table):
    """The data files of a table, by their bucket's folder."""
    found = {}
    for p in Path(store.path(table)).rglob("*.parquet"):
        found.setdefault(p.parent.name, set()).add(p.name)
    return found


def test_upserts_rewrite_only_the_buckets_of_their_keys(spark, store):
    store.append_new("claims", people(spark, *[(f"p{i}", i % 90, float(i)) for i in range(2000)]), now())
    before = parts(store, "claims")
    assert len(before) == store.buckets
    old = store.read("claims")
    keys = [("p7", 11, 1.0), ("p8", 12, 2.0), ("new", 13, 3.0)]
    assert store.upsert("claims", people(spark, *keys), now()) == 3
    after = parts(store, "claims")
    changed = {b for b in after if after[b] != before[b]}
    wanted = {f"{store.bucket}={n}" for n in store.touched(people(spark, *keys), F.col("PatientID"))}
    assert changed == wanted and 1 <= len(wanted) <= 3
    # A reader from before goes on with the buckets that were left alone, and no further.
    left = [n for n in range(store.buckets) if f"{store.bucket}={n}" not in wanted]
    assert store.in_buckets("claims", left).count() > 1800
    with pytest.raises(Exception, match="FILE_NOT_EXIST"):
        old.agg(F.sum("Age")).collect()
    assert store.read("claims").count() == 2001
    assert {r.PatientID: r.Age for r in store.read("claims").where("PatientID IN ('p7', 'p8', 'new', 'p9')").collect()} == {"p7": 11, "p8": 12, "new": 13, "p9": 9}


@pytest.mark.parametrize("key", ["PatientID", "TransactionID"])
def test_status_updates_rewrite_only_buckets_with_their_patients(spark, tmp_path, key):
    store = tb.ClaimStore(spark, str(tmp_path / "s"), claim_key=key)
    rows = [(f"T{i}", f"p{i // 2 if key == 'TransactionID' else i}", i) for i in range(1500)]
    store.append_new("claims", spark.createDataFrame(rows, "TransactionID string, PatientID string, Age int"), now())
    before = parts(store, "claims")
    updates = spark.createDataFrame([("p7", "Closed"), ("nobody", "Closed")], "PatientID string, Investigation_Status string")
    store.update_claim_status(updates, now(), "b")
    after = parts(store, "claims")
    held = [r[1] for r in rows if r[1] == "p7"]
    assert 1 <= sum(after[b] != before[b] for b in after) <= len(held)
    assert store.read("claims").where("Investigation_Status = 'Closed'").count() == len(held)
    assert store.read("claims").count() == 1500 and store.read("audit_log").count() == 2


def scanned_rows(df):
    """Rows that came out of the file scans of a frame's plan once it has run."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.getClass().getName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.mark.parametrize("users", [10, 200])
def test_a_users_rows_are_read_without_the_others(spark, tmp_path, users):
    """Pages of other users are skipped: the more users, the fewer rows are read for one."""
    store = tb.ClaimStore(spark, str(tmp_path / "s"), buckets=2)
    rows = spark.range(400_000).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("u"), F.xxhash64("id") % users).alias("uid"), F.lit("x").alias("filename")
    )
    rows = rows.withColumn("user_id", F.col("uid"))
    store.append("upload_sessions", tb.session_rows(rows, now()))
    mine = store.read("upload_sessions", "u3").select("id", "user_id")
    held = mine.count()
    assert 0 < held < 1.3 * 400_000 / users
    # Some 20,000 rows make a page; a user begins and ends in one of each file.
    assert held <= scanned_rows(mine) <= held + 2 * 2 * 20_000
    assert scanned_rows(store.read("upload_sessions").select("id", "user_id")) == 400_000


def test_a_table_keeps_its_number_of_buckets(spark, store):
    store.append_new("claims", people(spark, ("a", 1, 1.0)), now())
    other = tb.ClaimStore(spark, store.root, claim_key="PatientID", buckets=8)
    with pytest.raises(ValueError, match="8 buckets"):
        other.read("claims")
    with pytest.raises(ValueError, match="laid out by"):
        store.upsert("claims", people(spark, ("a", 1, 1.0)), now(), key="Age")


def test_rows_without_key_are_spread_and_survive_upserts(spark, tmp_path):
    store = tb.ClaimStore(spark, str(tmp_path / "s"), claim_key="PatientID")
    loose = spark.createDataFrame([(i, float(i)) for i in range(300)], "Age int, Final_Billed_Amount double")
    assert store.append_new("claims", loose, now())["new"] == 300
    assert len(parts(store, "claims")) > 30
    store.upsert("claims", people(spark, *[(f"p{i}", 1, 1.0) for i in range(200)]), now())
    assert store.read("claims").count() == 500 and store.read("claims").where("PatientID IS NULL").count() == 300


def test_missing_key_column_inserts_everything(spark, store):
    counts = store.append_new("audit_log", spark.createDataFrame([("x",), ("x",)], "action string"), now())
    assert counts["new"] == 2 and store.read("audit_log").count() == 2


def test_logs_fill_and_repeat(spark, store):
    uid = "0123456789-0123456789"
    events = spark.createDataFrame([("1", uid, "Login", None), ("2", "short", "Login", 5.0)], "id string, uid string, action string, amount double")
    assert store.log_audit_events(events, now()) == 2 and store.log_audit_events(events, now()) == 0
    rows = {r.id: r for r in store.read("audit_log").collect()}
    assert rows["1"].amount == 0.0 and rows["1"].patient_id == "" and rows["1"].user_id == uid and rows["2"].user_id is None
    sessions = spark.createDataFrame([("s", "guest", 5)], "id string, uid string, total_rows long")
    assert store.log_upload_sessions(sessions, now()) == 1
    row = store.read("upload_sessions").first()
    assert row.new_rows == 0 and row.suspicious_amt == 0.0 and row.uploaded_at == datetime(2024, 2, 1)


def test_status_update_touches_both_tables(spark, store):
    store.append_new("claims", people(spark, ("a", 1, 1.0), ("b", 1, 1.0)), now())
    store.upsert_detected_frauds(people(spark, ("a", 1, 1.0)), now(), "Final_Billed_Amount", "u")
    updates = spark.createDataFrame([("a", "Closed"), ("zz", "Closed")], "PatientID string, Investigation_Status string")
    store.update_claim_status(updates, now(), "b1", "u")
    assert {r.PatientID: r.Investigation_Status for r in store.read("claims").collect()} == {"a": "Closed", "b": None}
    assert [r.Investigation_Status for r in store.read_detected_frauds().collect()] == ["Closed"]
    log = {r.patient_id: r.description for r in store.read("audit_log").collect()}
    assert log["a"] == "Status for Patient a changed to 'Closed'." and len(log) == 2


def test_frauds_are_one_per_patient(spark, store):
    cases = spark.createDataFrame(
        [("a", "T1", 5.0, 0.6, "x"), ("a", "T0", 7.0, 0.9, "y")],
        "PatientID string, TransactionID string, TreatmentCost double, Risk_Score double, Disease string",
    )
    assert store.upsert_detected_frauds(cases, now(), "TreatmentCost") == 1
    row = store.read("detected_frauds").first()
    assert (row.Final_Billed_Amount, row.Primary_Diagnosis, row.Fraud_Type) == (7.0, "y", "Anomalous")
    assert set(store.read("detected_frauds").columns) == set(TABLES["detected_frauds"].names)


def test_csv_in_any_order_with_missing_cells(spark, store, tmp_path):
    path = tmp_path / "claims.csv"
    path.write_text(
        '﻿Age,PatientID,Final_Billed_Amount,Primary_Diagnosis,Admission_Timestamp,Extra\n41,a,12.5,"x, ""y""",2024-01-05 10:00,e\n'
        "NA,b,n/a,,junk,\nsome,c,NaN,z,01/31/2024,f\n"
    )
    rows = {r.PatientID: r for r in files.read_claims_csv(spark, str(path)).collect()}
    assert (rows["a"].Age, rows["a"].Final_Billed_Amount, rows["a"].Primary_Diagnosis) == (41, 12.5, 'x, "y"')
    assert rows["a"].Admission_Timestamp == datetime(2024, 1, 5, 10) and rows["c"].Admission_Timestamp == datetime(2024, 1, 31)
    assert rows["b"].Age is None and rows["b"].Final_Billed_Amount is None and rows["b"].Admission_Timestamp is None
    assert rows["c"].Age is None and rows["c"].Final_Billed_Amount is None and rows["c"].Extra == "f"
    assert store.sync_csv(str(path), now()) == (True, "✅ Sync Complete: 3 new rows added, 0 skipped.")
    assert store.sync_csv(str(path), now()) == (True, "✅ Sync Complete: 0 new rows added, 3 skipped.")


def test_rejected_cells_are_kept(spark, tmp_path):
    path = tmp_path / "claims.csv"
    path.write_text(
        "TransactionID,Age,Final_Billed_Amount,Admission_Timestamp,Extra\n"
        "t1,41,12.5,13/03/2024,x\nt2,old,NA,05/03/2024,y\nt3,,1e400,2024-13-01,z\nt4,7,3.0,06/03/2024,a,b\nt5,8\n"
    )
    checked = files.check_claims_csv(spark, str(path))
    rows = {r.TransactionID: r for r in checked.claims.collect()}
    assert len(rows) == 5 and rows["t2"].Admission_Timestamp == datetime(2024, 3, 5) and rows["t2"].Age is None
    assert (rows["t4"].Age, rows["t5"].Age, rows["t5"].Final_Billed_Amount) == (7, 8, None)
    assert checked.claims.columns == files.read_claims_csv(spark, str(path)).columns
    assert sorted(map(str, checked.claims.collect())) == sorted(map(str, files.read_claims_csv(spark, str(path)).collect()))
    rejects = {(json.loads(r.row)["TransactionID"], r.column_name, r.cell) for r in checked.rejects.collect()}
    assert rejects == {
        ("t2", "Age", "old"),
        ("t3", "Admission_Timestamp", "2024-13-01"),
        ("t4", "(line)", "t4,7,3.0,06/03/2024,a,b"),
        ("t5", "(line)", "t5,8"),
    }
    assert {r.file for r in checked.rejects.collect()} == {"claims.csv"}
    report = {r.column_name: (r.cells, r.accepted, r.rejected) for r in checked.report.collect()}
    assert report == {"Age": (4, 3, 1), "Final_Billed_Amount": (3, 3, 0), "Admission_Timestamp": (4, 3, 1), "(line)": (5, 3, 2)}
    (tmp_path / "empty.csv").write_text("TransactionID,Age\n")
    nothing = files.check_claims_csv(spark, str(tmp_path / "empty.csv"))
    assert nothing.claims.isEmpty() and nothing.rejects.isEmpty()
    assert all((r.cells, r.rejected) == (0, 0) for r in nothing.report.collect())


def test_sync_reports_missing_and_empty_files(spark, store, tmp_path):
    assert store.sync_csv(str(tmp_path / "none.csv"), now())[0] is False
    (tmp_path / "empty.csv").write_text("PatientID,Age\n")
    assert store.sync_csv(str(tmp_path / "empty.csv"), now()) == (False, "CSV file is empty.")


def test_first_source_with_rows(spark, store, tmp_path):
    missing = lambda: spark.read.parquet(str(tmp_path / "none"))
    some = lambda: people(spark, ("a", 1, 1.0))
    assert files.load_first_nonempty([missing, lambda: store.read("claims"), some]).count() == 1
    assert files.load_first_nonempty([missing, lambda: None]) is None


def test_sanitize(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 5, 10), math.inf, 1), (datetime(2024, 1, 5, 10, 0, 0, 5), math.nan, None), (None, 2.5, 3)],
        "t timestamp, x double, n int",
    )
    assert [tuple(r) for r in files.sanitize_for_sink(df).collect()] == [
        ("2024-01-05T10:00:00", None, 1),
        ("2024-01-05T10:00:00.000005", None, None),
        (None, 2.5, 3),
    ]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(" 🚨 ₹5 हिन्दी é ", 1), (None, 2)], "text string, n int")
    path = files.export_audit_csv(df.coalesce(1), str(tmp_path), datetime(2024, 2, 1, 9, 5), bom=True)
    assert path.endswith("Fraud_Audit_Export_20240201_0905.csv")
    lines = b"".join(p.read_bytes() for p in (tmp_path / "Fraud_Audit_Export_20240201_0905.csv").glob("*.csv"))
    assert lines.startswith(b"\xef\xbb\xbftext,n\n")
    assert "  ₹5 हिन्दी  ,1" in lines.decode("utf-8-sig")


def test_upload_can_be_repeated(spark, small, tmp_path):
    store = tb.ClaimStore(spark, str(tmp_path / "store"), claim_key="TransactionID")
    claims = fx.claims(spark, small)
    settings = au.Settings("app", trees=20)
    first = au.process_upload(store, claims, "u1", "a.csv", now(), "auditor", settings)
    tables = ("claims", "detected_frauds", "upload_sessions", "audit_log")
    sizes = [store.read(t).count() for t in tables]
    again = au.process_upload(store, claims, "u1", "a.csv", now(), "auditor", settings)
    assert [store.read(t).count() for t in tables] == sizes
    assert first["total"] == first["Total_Rows"] == 6000
    # The counts of a batch that is run again are those of its first run.
    assert again["new"] == first["new"] and again["skipped"] == first["skipped"]
    flagged = store.read("claims").where("Fraud_Flag = 1")
    assert flagged.count() <= first["Fraud_Found"] and flagged.where("AI_Justification = ''").count() == 0
    patients = flagged.select("PatientID").distinct()
    assert store.read("detected_frauds").count() == patients.count()
    entry = store.read("audit_log").first()
    assert entry.description == f"Processed 6000 rows from a.csv. Detected {first['Fraud_Found']} frauds."


def test_empty_upload(spark, small, tmp_path):
    store = tb.ClaimStore(spark, str(tmp_path / "store"), claim_key="PatientID")
    empty = fx.claims(spark, small).where("false")
    got = au.process_upload(store, empty, "u0", "none.csv", now(), None, au.Settings("app", trees=5))
    assert got["Total_Rows"] == 0 and got["Fraud_Percent"] is None and got["new"] == 0
    assert store.read("detected_frauds").count() == 0
    assert au.queue_context(store.read("detected_frauds")).first().Context.endswith("No fraud cases in queue.")
    assert sm.audit_summary(store.read("detected_frauds")).first().Avg_Risk_Percent is None


def test_ingest_stream_equals_append_and_restarts(spark, tmp_path):
    arrivals, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    streamed, batch = tb.ClaimStore(spark, str(tmp_path / "s"), claim_key="PatientID"), tb.ClaimStore(spark, str(tmp_path / "b"), claim_key="PatientID")
    for i in range(3):
        rows = people(spark, *[(f"p{k}", i, float(k)) for k in range(i * 5, i * 5 + 8)])
        rows.write.mode("append").parquet(arrivals)
        batch.append_new("claims", rows, now())
        stream = spark.readStream.schema(rows.schema).parquet(arrivals)
        ingest.ingest_stream(stream, streamed, now(), progress).awaitTermination()
    got, want = (sorted(s.read("claims").drop("batch_id").collect()) for s in (streamed, batch))
    assert got == want


def test_startup_takes_stored_claims_then_the_file(spark, small, store, tmp_path):
    settings = au.Settings("app", trees=5)
    path = str(tmp_path / "claims.csv")
    assert au.startup_audit(store, path, "u", settings) is None
    claims = fx.claims(spark, small).select("TransactionID", "PatientID", "Final_Billed_Amount")
    claims.write.csv(path, header=True)
    assert au.startup_audit(store, path, "u", settings).count() == 6000
    store.append_new("claims", people(spark, *[(f"p{i}", i, float(i)) for i in range(20)]), now(), user_id="u")
    verdicts = au.startup_audit(store, path, "u", settings)
    assert verdicts.count() == 20 and verdicts.where("Fraud_Flag = 1").count() == 0
    assert len(set(verdicts.columns)) == len(verdicts.columns)


def test_settings_are_checked_and_logged(store):
    with pytest.raises(ValueError):
        au.Settings("app", contamination=0.6)
    assert au.settings_event(store, au.Settings("app", 0.2, 50), "e1", now()) == 1
    row = store.read("audit_log").first()
    assert (row.uid, row.description) == ("guest", "Updated sensitivity to 0.2 and trees to 50.")


def test_append_that_ended_early_is_completed(spark, tmp_path):
    store = tb.ClaimStore(spark, str(tmp_path / "store"), claim_key="PatientID")
    rows = people(spark, *[(f"p{i}", i, float(i)) for i in range(10)])
    store.append_new("claims", people(spark, ("p1", 1, 1.0)), now())
    first = store.append_new("claims", rows, now(), batch_id="b")
    assert (first["new"], first["skipped"]) == (9, 1)
    # As if only some of the rows had come in.
    half = tb.ClaimStore(spark, str(tmp_path / "half"), claim_key="PatientID")
    half.append("claims", store.read("claims").where("PatientID < 'p5'"))
    for again in (half, half, store):
        assert again.append_new("claims", rows, now(), batch_id="b") == first
        assert sorted(r.PatientID for r in again.read("claims").collect()) == [f"p{i}" for i in range(10)]


class Stop(Exception):
    pass


def test_counts_survive_a_micro_batch_that_failed_after_its_write(spark, tmp_path, monkeypatch):
    store, arrivals, progress = tb.ClaimStore(spark, str(tmp_path / "s"), claim_key="PatientID"), str(tmp_path / "in"), str(tmp_path / "progress")
    store.append_new("claims", people(spark, ("p1", 1, 1.0)), now())

    def arrive(*rows):
        people(spark, *rows).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema("PatientID string, Age int, Final_Billed_Amount double").parquet(arrivals)
        return ingest.ingest_stream(stream, store, now(), progress)

    arrive(("p1", 2, 2.0), ("p2", 3, 3.0), ("p2", 4, 4.0), (None, 5, 5.0)).awaitTermination()

    def stop(*_):
        raise Stop

    with monkeypatch.context() as patch:
        patch.setattr(tb.ClaimStore, "record_batch", stop)
        with pytest.raises(PySparkException):
            arrive(("p3", 1, 1.0), ("p2", 9, 9.0)).awaitTermination()
    assert store.read("claims").count() == 3
    for rows in ((("p4", 1, 1.0),), (("p4", 1, 1.0),)):
        arrive(*rows).awaitTermination()
    names = ["batch_id", "total", "new", "skipped", "in_batch_duplicates", "null_keys"]
    assert sorted(tuple(r[n] for n in names) for r in store.read("ingest_batches").collect()) == [
        ("ingest-0", 4, 1, 1, 1, 1),
        ("ingest-1", 2, 1, 1, 0, 0),
        ("ingest-2", 1, 1, 0, 0, 0),
        ("ingest-3", 1, 0, 1, 0, 0),
    ]
    assert sorted(r.PatientID for r in store.read("claims").collect()) == ["p1", "p2", "p3", "p4"]


def test_repeats_within_the_delay_go_before_the_store(spark, tmp_path):
    store, arrivals, progress = tb.ClaimStore(spark, str(tmp_path / "s"), claim_key="PatientID"), str(tmp_path / "in"), str(tmp_path / "progress")
    for rows in ([("a", 1, 1.0), ("b", 1, 1.0), (None, 1, 1.0), (None, 2, 1.0)], [("a", 2, 2.0), ("c", 1, 1.0), ("a", 3, 3.0)]):
        people(spark, *rows).coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema("PatientID string, Age int, Final_Billed_Amount double").parquet(arrivals)
        ingest.ingest_stream(stream, store, now(), progress, within="1 hour").awaitTermination()
    counts = sorted((r.total, r.new, r.skipped, r.null_keys) for r in store.read("ingest_batches").collect())
    assert counts == [(1, 1, 0, 0), (4, 2, 0, 2)]
    assert {r.PatientID: r.Age for r in store.read("claims").collect()} == {"a": 1, "b": 1, "c": 1}


def cut(spark):
    """The intermediate tables written so far."""
    return set(Path(shared_folder(spark)).glob("k*"))


@pytest.mark.parametrize("key", ["PatientID", "TransactionID"])
def test_a_file_synced_again_is_decided_by_its_keys(spark, tmp_path, key):
    """Before, every row of the file was written and matched again, though none is new."""
    path, store = str(tmp_path / "claims"), tb.ClaimStore(spark, str(tmp_path / "s"), claim_key=key)
    rows = [(f"p{i % 70}" if i % 9 else None, i, float(i), f"t{i % 90}" if i % 11 else None) for i in range(200)]
    claims = spark.createDataFrame(rows, "PatientID string, Age int, Final_Billed_Amount double, TransactionID string")
    claims.repartition(3).write.csv(path, header=True)
    keys = {r[0 if key == "PatientID" else 3] for r in rows} - {None}
    keyless = sum(r[0 if key == "PatientID" else 3] is None for r in rows)
    before = cut(spark)
    assert store.sync_csv(path, now()) == (True, f"✅ Sync Complete: {len(keys)} new rows added, 0 skipped.")
    assert cut(spark) == before
    assert store.sync_csv(path, now()) == (True, f"✅ Sync Complete: 0 new rows added, {200 - keyless} skipped.")
    (marks,) = cut(spark) - before
    marked = spark.read.parquet(str(marks))
    assert sorted(marked.columns) == ["_copies", "_key", "_known", "_stored"]
    assert {r[0] for r in marked.select("_key").collect()} == {"", None}
    other = tb.ClaimStore(spark, str(tmp_path / "o"), claim_key=key)
    other.append_new("claims", files.read_claims_csv(spark, path), now())
    held = [sorted(map(str, s.read("claims").collect())) for s in (store, other)]
    assert held[0] == held[1] and len(held[0]) == len(keys)
    # A file that has grown: only what is new comes in.
    spark.createDataFrame([("p1", 9, 9.0, "t1"), ("q", 9, 9.0, "u"), ("q", 8, 8.0, "u")], claims.schema).write.csv(path, header=True, mode="append")
    assert store.sync_csv(path, now()) == (True, f"✅ Sync Complete: 1 new rows added, {200 - keyless + 1} skipped.")
    assert [r.Age for r in store.read("claims").where("PatientID = 'q'").collect()] == [8]
    assert store.read("claims").count() == len(keys) + 1


def test_a_file_without_keys_adds_nothing(spark, store, tmp_path):
    path = tmp_path / "claims.csv"
    path.write_text("PatientID,Age\nNA,1\n,2\n")
    assert store.sync_csv(str(path), now()) == (True, "✅ Sync Complete: 0 new rows added, 0 skipped.")
    assert store.read("claims").count() == 0 and not Path(store.path("claims")).exists()


def test_a_large_table_is_still_searched_by_the_batch(spark, store, tmp_path):
    store.append_new("claims", people(spark, *[(f"p{i}", i, float(i)) for i in range(50)]), now())
    path = tmp_path / "claims.csv"
    path.write_text("PatientID,Age\np3,1\nq,2\n")
    before = cut(spark)
    assert store.sync_csv(str(path), now()) == (True, "✅ Sync Complete: 1 new rows added, 1 skipped.")
    assert {p.name.split("-")[0] for p in cut(spark) - before} == {"keys", "known"}
    assert store.read("claims").count() == 51


def test_defaults_are_filled_in_behind_the_shuffle(spark, tmp_path):
    """The same rows in the same buckets as those brought into the layout first."""
    rows = people(spark, *[(f"p{i}" if i % 3 else None, i, float(i)) for i in range(300)]).withColumn("Extra", F.lit(1))
    defaults = tb.defaults_of("claims", now())
    first, behind = tb.ClaimStore(spark, str(tmp_path / "f"), claim_key="PatientID"), tb.ClaimStore(spark, str(tmp_path / "b"), claim_key="PatientID")
    first.append("claims", tb.conform(rows, first.schema("claims"), defaults))
    behind.append("claims", rows, defaults)
    held = [sorted(map(str, s.bucketed("claims").collect())) for s in (first, behind)]
    assert held[0] == held[1] and len(held[0]) == 300
