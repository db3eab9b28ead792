"""Optional columns, profiles, missing keys and the rules on hand-made claims."""

import math
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from claimsift.functions import risk
from claimsift.operators import features as ft
from claimsift.plans import audit as au
from claimsift.sources import tables as tb

SCHEMA = (
    "TransactionID string, PatientID string, Hospital_PIN long, Age int, Gender string, Primary_Diagnosis string, "
    "Final_Billed_Amount double, Base_Package_Rate double, Admission_Timestamp string, Discharge_Timestamp string, "
    "PreAuth_Request_Date string, PreAuth_Approval_Date string"
)


def claim(number, **changes):
    row = {
        "TransactionID": f"T{number}",
        "PatientID": f"P{number}",
        "Hospital_PIN": 1,
        "Age": 40,
        "Gender": "Female",
        "Primary_Diagnosis": "Cataract",
        "Final_Billed_Amount": 1000.0,
        "Base_Package_Rate": 1000.0,
        "Admission_Timestamp": "2024-01-01 10:00:00",
        "Discharge_Timestamp": "2024-01-04 10:00:00",
        "PreAuth_Request_Date": "2024-01-01",
        "PreAuth_Approval_Date": "2024-01-02",
    }
    return tuple({**row, **changes}.values())


def claims(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def by_id(df):
    return {r.TransactionID: r for r in df.collect()}


def test_rules_and_types(spark):
    df = claims(
        spark,
        claim(1),
        claim(2, Base_Package_Rate=0.0),
        claim(3, Final_Billed_Amount=2600.0),
        claim(4, Final_Billed_Amount=2500.0),
        claim(5, Discharge_Timestamp="2024-01-01 20:00:00"),
        claim(6, Gender="Male", Primary_Diagnosis="Maternity Care"),
        claim(7, Gender="male", Primary_Diagnosis="Maternity Care"),
        claim(8, Base_Package_Rate=math.nan),
        claim(9, Discharge_Timestamp="soon", Base_Package_Rate=None),
        claim(10, PatientID="X"),
        claim(11, PatientID="X", Hospital_PIN=2),
        claim(12, PatientID="X", Hospital_PIN=None),
        claim(13, PatientID=None, Hospital_PIN=7),
        claim(14, PatientID=None, Hospital_PIN=None),
    )
    app = by_id(au.rules_only(df, "app"))
    batch = by_id(au.rules_only(df, "batch"))
    assert {k for k, r in app.items() if r.Rule_Fraud} == {"T2", "T3", "T5", "T6"}
    assert {k for k, r in batch.items() if r.Rule_Fraud} == {"T2", "T3", "T5", "T10", "T11", "T12"}
    assert app["T2"].Fraud_Type == "Ghost Billing" and app["T2"].Cost_to_Package == 1000.0
    assert app["T3"].Fraud_Type == "Up-coding" and batch["T3"].Fraud_Type == "Upcoding"
    assert app["T5"].Fraud_Type == "Fake Admission" and app["T11"].Fraud_Type == "Identity Misuse"
    assert app["T8"].Cost_to_Package is None and app["T8"].Risk_Score == 0.0
    assert app["T9"].LOS is None and app["T9"].Fraud_Type == "Anomalous Pattern"
    assert app["T13"].Patient_Claim_Count is None and app["T14"].Hospital_Avg_Cost is None
    assert app["T12"].Patient_Claim_Count == 3
    assert app["T3"].Rules == ["ratio"] and app["T1"].Rules == []


def test_means_skip_missing_amounts(spark):
    df = claims(
        spark,
        claim(1, Final_Billed_Amount=100.0),
        claim(2, Final_Billed_Amount=math.nan),
        claim(3, Final_Billed_Amount=None),
        claim(4, Final_Billed_Amount=300.0),
        claim(5, Hospital_PIN=2, Final_Billed_Amount=math.inf),
        claim(6, Hospital_PIN=3, Final_Billed_Amount=1e40),
        claim(7, Hospital_PIN=4, Final_Billed_Amount=None),
    )
    got = by_id(ft.derive_features(ft.typed_claims(df)))
    assert got["T2"].Hospital_Avg_Cost == 200.0
    assert got["T5"].Hospital_Avg_Cost == math.inf and got["T6"].Hospital_Avg_Cost == 1e40
    assert got["T7"].Hospital_Avg_Cost is None
    values = by_id(ft.derive_features(ft.typed_claims(df)).select("TransactionID", *ft.feature_values(["Hospital_Avg_Cost"])))
    assert values["T5"].Hospital_Avg_Cost == 0.0 and values["T7"].Hospital_Avg_Cost == 0.0


def test_missing_columns_take_defaults(spark):
    bare = claims(spark, claim(1), claim(2)).select(
        "TransactionID", F.col("Final_Billed_Amount").alias("TreatmentCost"), F.col("Primary_Diagnosis").alias("Disease")
    )
    row = au.rules_only(bare, "app").first()
    assert (row.LOS, row.PreAuth_Delay, row.Cost_to_Package, row.Patient_Claim_Count) == (1, 0, 1.0, 1)
    assert row.Hospital_Avg_Cost == 1000.0 and row.Rule_Fraud == 0
    assert ft.resolve_cost_col(bare) == "TreatmentCost"
    mapped = tb.to_fraud_schema(bare, "TreatmentCost").first()
    assert mapped.Final_Billed_Amount == 1000.0 and mapped.Primary_Diagnosis == "Cataract"
    nothing = bare.select("TransactionID")
    assert ft.resolve_cost_col(nothing) is None
    assert au.rules_only(nothing, "app").first().Hospital_Avg_Cost == 0.0
    half = claims(spark, claim(1)).drop("PreAuth_Request_Date")
    assert au.rules_only(half, "app").first().PreAuth_Delay == 0
    with pytest.raises(ValueError):
        au.rules_only(bare, "batch")


def test_texts_become_typed(spark):
    df = spark.createDataFrame(
        [("T1", "560001.0", "41", "12.5"), ("T2", "", "", "nan"), ("T3", " H12 ", "4", "1"), ("T4", "9007199254740993", "4", "1")],
        "TransactionID string, Hospital_PIN string, Age string, Final_Billed_Amount string",
    )
    rows = by_id(ft.typed_claims(df))
    assert (rows["T1"].Hospital_PIN, rows["T1"].Age, rows["T1"].Final_Billed_Amount) == ("560001", 41, 12.5)
    assert (rows["T2"].Hospital_PIN, rows["T2"].Age, rows["T2"].Final_Billed_Amount) == (None, None, None)
    assert (rows["T3"].Hospital_PIN, rows["T4"].Hospital_PIN) == ("H12", "9007199254740993")


def test_hospital_ids_of_any_kind_are_told_apart(spark):
    pins = ["H12", "H13", "9007199254740993", "9007199254740992"]
    rows = [(f"T{i}", "A" if i < 2 else "B", pin, float(i)) for i, pin in enumerate(pins)] + [("T4", "C", "H12", 10.0)]
    df = spark.createDataFrame(rows, "TransactionID string, PatientID string, Hospital_PIN string, Final_Billed_Amount double")
    got = by_id(ft.derive_features(ft.typed_claims(df)))
    assert [got[f"T{i}"].Hospital_Avg_Cost for i in range(5)] == [5.0, 1.0, 2.0, 3.0, 5.0]
    assert [got[f"T{i}"].Multi_Hospital for i in range(5)] == [True, True, True, True, False]


def test_justifications(spark):
    df = claims(
        spark,
        claim(1, Base_Package_Rate=0.0, Final_Billed_Amount=12500.5),
        claim(2, Final_Billed_Amount=3333.0),
        claim(3, Discharge_Timestamp="2023-12-31 09:00:00", Final_Billed_Amount=2100.0, Age=None),
        claim(4, Gender="Male", Primary_Diagnosis="Maternity Care", Final_Billed_Amount=2100.0),
        claim(5),
    )
    got = by_id(au.rules_only(df, "app"))
    assert got["T1"].AI_Justification.startswith("GHOST BILLING DETECTED — Hospital 1 submitted ₹12,500 for patient P1 (Age: 40, Dx: Cataract)")
    assert "is 3.3x the approved package rate for 'Cataract'" in got["T2"].AI_Justification
    assert "Risk Score: 0.60/1.00." in got["T2"].AI_Justification
    assert "Patient P3 (Age: ?) at hospital 1 has LOS of -2 days" in got["T3"].AI_Justification
    assert got["T4"].AI_Justification.startswith("ANOMALOUS PATTERN — ML model flagged patient P4")
    assert got["T5"].AI_Justification == ""


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([-1, 1]), st.floats(0, 6)), min_size=1, max_size=30), st.sampled_from(["app", "batch"]))
def test_a_claim_is_flagged_only_with_a_rule(spark, rows, profile):
    df = spark.createDataFrame(rows, "Rule_Fraud int, ML_Anomaly int, Cost_to_Package double")
    scored = df.withColumn("Risk_Score", risk.risk_score(profile)).withColumn("Fraud_Flag", risk.fraud_flag())
    for r in scored.collect():
        assert r.Fraud_Flag == int(r.Rule_Fraud == 1 and (r.ML_Anomaly == -1 or r.Cost_to_Package > 2))


def test_missing_diagnosis_uses_hospital_id(spark):
    df = claims(spark, claim(1, Base_Package_Rate=0.0)).drop("Hospital_PIN", "Primary_Diagnosis").withColumn("HospitalID", F.lit("H9"))
    text = au.rules_only(df, "app").first().AI_Justification
    assert "Hospital H9 submitted" in text and "Dx: Unknown" in text


def test_parse_keeps_timestamps(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),)], "Admission_Timestamp timestamp")
    assert ft.parse_timestamps(df).first()[0] == datetime(2024, 1, 1)


def times(spark, *columns):
    """A frame with one text column of times per list of cells."""
    from claimsift.schema import TIME_COLUMNS

    names = TIME_COLUMNS[: len(columns)]
    return spark.createDataFrame(list(zip(*columns)), ", ".join(f"{n} string" for n in names)), names


def test_a_column_has_one_layout(spark):
    """One day above 12 decides for all cells; what does not fit is counted."""
    day_first = ["05/03/2024", "13/03/2024", "01/02/2024 08:30", None, " ", "junk"]
    month_first = ["05/03/2024", "03/13/2024", "01/02/2024 8:30 PM", "13/13/2024", None, "2024-05-06"]
    either = ["05/03/2024", "01/02/2024", None, None, None, None]
    dots = ["5.3.2024", "13.3.2024", "1.2.2024", "31.12.2024", "03/04/2024", "2024-01-02T03:04:05"]
    df, names = times(spark, day_first, month_first, either, dots)
    found = ft.time_layouts(df)
    assert [(found[n].layout, found[n].cells, found[n].misfits) for n in names] == [
        ("d/M/yyyy", 4, 1),
        ("M/d/yyyy", 5, 1),
        ("M/d/yyyy", 2, 0),
        ("d.M.yyyy", 6, 1),
    ]
    rows = [tuple(r) for r in ft.parse_timestamps(df).collect()]
    assert [r[0] for r in rows] == [datetime(2024, 3, 5), datetime(2024, 3, 13), datetime(2024, 2, 1, 8, 30), None, None, None]
    assert [r[1] for r in rows] == [datetime(2024, 5, 3), datetime(2024, 3, 13), datetime(2024, 1, 2, 20, 30), None, None, datetime(2024, 5, 6)]
    assert [r[2] for r in rows][:2] == [datetime(2024, 5, 3), datetime(2024, 1, 2)]
    assert [r[3] for r in rows] == [datetime(2024, 3, 5), datetime(2024, 3, 13), datetime(2024, 2, 1), datetime(2024, 12, 31), None, datetime(2024, 1, 2, 3, 4, 5)]


def test_given_layouts_are_not_inferred_again(spark):
    df, names = times(spark, ["01/02/2024", "03/04/2024"])
    layouts = {names[0]: ft.TimeLayout("d/M/yyyy", 0, 0)}
    assert [r[0] for r in ft.typed_claims(df, layouts=layouts).collect()] == [datetime(2024, 2, 1), datetime(2024, 4, 3)]


def test_columns_of_nothing_but_gaps(spark):
    df, names = times(spark, [None, ""])
    assert ft.time_layouts(df)[names[0]] == ft.TimeLayout(None, 0, 0)
    assert [r[0] for r in ft.parse_timestamps(df).collect()] == [None, None]
    assert ft.time_layouts(df.where("false"))[names[0]].cells == 0
    assert ft.layout_report(spark, ft.time_layouts(df)).first().layout == "ISO"
