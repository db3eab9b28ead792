"""Claims that a query reads several times are joined once, and no more is written than is read."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from claimsift.functions import values as vl
from claimsift.operators import features as ft
from claimsift.plans import audit as au
from claimsift.plans.catalog import QUERIES
from claimsift.session import shared_folder
from claimsift.sources import fixtures as fx, tables as tb


def tables(spark, folder):
    """Line items, one of them twice, one without its order and one with null numbers."""
    day = F.timestamp_seconds(F.lit(9e8)).cast("timestamp_ntz")
    rows = [(n % 9, n % 5, n % 7, n % 4 + 1, float(n % 50), 100.0 * n, 0.01 * (n % 3)) for n in range(60)]
    rows += [rows[3], (77, 1, 1, 1, 1.0, 1.0, 0.0), (1, 2, None, 3, None, None, None)]
    line = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double")
    order = spark.range(9).select(F.col("id").alias("o_orderkey"), (F.col("id") * 3).alias("o_custkey"), day.alias("o_orderdate"))
    part = spark.range(5).select(F.col("id").alias("p_partkey"), F.lit("ECONOMY").alias("p_type"), F.lit(3.5).alias("p_retailprice"))
    for name, df in (("lineitem", line), ("orders", order), ("part", part)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_stored_claims_are_the_same_claims(spark, tmp_path):
    folder = tables(spark, tmp_path)
    derived, stored = fx.claims(spark, folder), fx.claims(spark, folder, stored=True)
    assert stored.dtypes == derived.dtypes and stored.count() == 62
    assert derived.exceptAll(stored).isEmpty() and stored.exceptAll(derived).isEmpty()
    assert stored._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_scored_claims_carry_what_is_asked_for(spark, tmp_path):
    claims, run = fx.claims(spark, tables(spark, tmp_path)), au.Settings("batch", trees=5)
    whole = au.scored_claims(claims, run, ["TransactionID"])
    wanted = ["TransactionID", "Path_Sum", "Anomaly_Score"]
    slim = au.scored_claims(claims, run, ["TransactionID"], columns=["Path_Sum", "Anomaly_Score"])
    assert set(slim.columns) == set(wanted) and {"Rules", "LOS"} <= set(whole.columns)
    assert whole.select(wanted).exceptAll(slim.select(wanted)).isEmpty() and slim.count() == whole.count() == 62


def written(label, before):
    """The frames' folders with a label that came into the shared folder since ``before``."""
    return [p for p in sorted(Path(before[0]).glob(f"{label}-*")) if p not in before[1]]


def folders(spark):
    return shared_folder(spark), set(Path(shared_folder(spark)).iterdir())


def test_claims_store_only_what_their_columns_are_made_of(spark, tmp_path):
    folder, before = tables(spark, tmp_path), folders(spark)
    wanted = ["PatientID", "Final_Billed_Amount"]
    derived, stored = fx.claims(spark, folder).select(*wanted), fx.claims(spark, folder, stored=True, columns=wanted)
    assert stored.dtypes == derived.dtypes and stored.count() == 62
    assert derived.exceptAll(stored).isEmpty() and stored.exceptAll(derived).isEmpty()
    (lines,) = written("lines", before)
    assert set(pq.ParquetDataset(lines).schema.names) == {"l_orderkey", "l_linenumber", "l_extendedprice"}
    assert pq.ParquetFile(next(lines.glob("*.parquet"))).metadata.row_group(0).column(0).compression == "ZSTD"


def test_stored_claims_are_appended_by_their_keys(spark, tmp_path):
    folder, before = tables(spark, tmp_path), folders(spark)
    got = QUERIES["s04_append_by_claim"](spark, folder)
    claims = fx.claims(spark, folder)
    assert got.count() == claims.where("TransactionID is not null").select("TransactionID").distinct().count()
    for keys in written("keys", before):
        assert not {"Age", "Final_Billed_Amount"} & set(pq.ParquetDataset(keys).schema.names)


def test_a_union_by_key_looks_up_no_figures_that_nobody_reads(spark, tmp_path):
    got = QUERIES["u02_keyed_union"](spark, tables(spark, tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Patient_Claim_Count" not in plan and plan.count("Join") == 1


def test_a_number_stands_once_where_nan_is_taken_out(spark):
    df = spark.createDataFrame([(1.0, 1.5), (float("nan"), float("nan")), (None, None), (float("-inf"), 0.0)], "x double, y float")
    twice = df.select(*[vl.nan_to_null(vl.nan_to_null(F.col(c))).alias(c) for c in df.columns])
    assert twice.dtypes == df.dtypes
    assert twice.collect() == [(1.0, 1.5), (None, None), (None, None), (float("-inf"), 0.0)]
    plan = twice.where("x > 7")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Filter")[1].split("\n")[0].count("x#") <= 2


def test_a_scored_stream_makes_its_figures_once(spark, tmp_path, monkeypatch):
    calls, given = [], {}
    for name in ("hospital_figures", "patient_figures"):
        plain = getattr(ft, name)
        monkeypatch.setattr(ft, name, lambda claims, *rest, name=name, plain=plain: (calls.append(name), plain(claims, *rest))[1])
    scored = au.scored_claims
    monkeypatch.setattr(au, "scored_claims", lambda *a, **k: given.setdefault("scored", scored(*a, **k)))
    assert QUERIES["r04_scored_stream"](spark, tables(spark, tmp_path)).count() == 62
    # Once each for all claims, and the patients once more for those of the pool.
    assert sorted(calls) == ["hospital_figures", "patient_figures", "patient_figures"]
    assert given["scored"].columns == ["Path_Sum"] and given["scored"].count() == 62


def test_stored_figures_are_the_figures(spark, tmp_path):
    claims = ft.typed_claims(fx.claims(spark, tables(spark, tmp_path)))
    hospitals, patients = ft.store_hospital_figures(claims), ft.patient_figures(claims)
    made, stored = ft.derive_features(claims), ft.derive_features(claims, hospitals, patients).select(*ft.derive_features(claims).columns)
    assert made.count() == 62 and made.exceptAll(stored).isEmpty() and stored.exceptAll(made).isEmpty()


def same_rows(one, two):
    """Whether two frames hold the same rows, whatever the order of their columns."""
    two = two.select(*one.columns)
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_an_upsert_of_stored_rows_writes_them_once(spark, tmp_path):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = [(f"p{n % 40}" if n % 9 else None, n, float(n % 7) / 10) for n in range(90)]
    spark.createDataFrame(rows, "PatientID string, Age int, Risk_Score double").write.parquet(str(tmp_path / "rows"))
    given = spark.read.parquet(str(tmp_path / "rows"))
    stores = [tb.ClaimStore(spark, str(tmp_path / name), claim_key="PatientID", buckets=8) for name in ("plain", "stored")]
    for k, store in enumerate(stores):
        store.append("claims", given.limit(0).select(F.lit(None).cast("string").alias("PatientID")), {"uploaded_at": now})
        store.append_new("claims", spark.createDataFrame([("p1", 7), ("q", 8)], "PatientID string, Age int"), now)
        before = folders(spark)
        assert store.upsert("claims", given, now, stored=k == 1) == given.select("PatientID").dropna().distinct().count()
        assert len(written("upsert", before)) == 1 - k
        assert store.upsert("claims", given.where("Age < 0"), now, stored=k == 1) == 0
    plain, stored = [s.read("claims") for s in stores]
    assert plain.count() == 41 and same_rows(plain, stored)


def test_an_upload_writes_no_verdicts_beside_the_scores(spark, tmp_path):
    now, run = F.lit("2024-02-01 00:00:00").cast("timestamp"), au.Settings("app", trees=5)
    claims = ft.typed_claims(fx.claims(spark, tables(spark, tmp_path), stored=True))
    stores, told = [], []
    for stored in (False, True):
        store, before = tb.ClaimStore(spark, str(tmp_path / f"store{stored}"), buckets=8), folders(spark)
        told.append(au.process_upload(store, claims, "u1", "a.csv", now, "ann", run, stored=stored))
        told.append(au.process_upload(store, claims, "u2", "a.csv", now, "ann", run, stored=stored))
        assert not written("verdicts", before) and not written("upsert", before)
        for scored in written("scored", before):
            assert not {"Admission_Timestamp", "Gender", "Rules", "Hospital_Avg_Cost"} & set(pq.ParquetDataset(scored).schema.names)
        stores.append(store)
    assert told[:2] == told[2:] and told[0]["new"] > 0 and told[1]["skipped"] > 0
    judged = au.audited(claims, run)
    for table in ("claims", "detected_frauds", "upload_sessions", "audit_log"):
        assert same_rows(*[s.read(table) for s in stores])
    wanted = ["TransactionID", "Fraud_Flag", "Risk_Score", "Fraud_Type", "AI_Justification"]
    assert stores[1].read("claims").select(wanted).exceptAll(judged.select(wanted)).isEmpty()
