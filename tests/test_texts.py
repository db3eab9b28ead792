"""Texts whose values are written out here, not taken from the engine."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimsift.functions import risk, text as tx
from claimsift.operators import summaries as sm
from claimsift.plans import audit as au


@pytest.mark.parametrize(
    "value",
    [0.0, 1.5, 999.0, 12345678.5, 1e7, 0.0005, 0.0001, 0.00005, 1e15, 123456789012345.6, 1e16, 1.25e20, 1e-12, -34567890.25, 1 / 3],
)
def test_float_text_is_pythons(spark, value):
    row = spark.createDataFrame([(value,)], "v double").select(tx.float_text(F.col("v")).alias("t")).first()
    assert row.t == str(value)


def test_prompt_has_plain_amounts_and_no_name(spark):
    row = (42, "Flu", 12345678.5, 1000.0, 3, "Up-coding")
    df = spark.createDataFrame([row], "Age int, Primary_Diagnosis string, Final_Billed_Amount double, Base_Package_Rate double, LOS long, Fraud_Type string")
    assert df.select(risk.llm_prompt().alias("p")).first().p == (
        "You are auditing a health-insurance claim.\n\n"
        "Age: 42\nDiagnosis: Flu\nCost: ₹12345678.5\nPackage Rate: 1000.0\n"
        "Length of Stay: 3 days\nFraud Type: Up-coding\n"
        "Don't use emojis.\nDon't include hospital/patient IDs.\n"
        "Just give the core reason in one simple sentence.\n"
        "Explain briefly why this claim looks suspicious."
    )


def test_stand_in_without_values(spark):
    df = spark.createDataFrame([(None, None, None, None), (" ", 1234.0, "Up-coding", 0.5)], "e string, c double, k string, r double")
    got = [r.t for r in df.select(risk.fallback_justification(*map(F.col, "eckr")).alias("t")).collect()]
    assert got == ["₹0 flagged — nan. Risk: 0.00. Manual review needed.", "₹1,234 flagged — Up-coding. Risk: 0.50. Manual review needed."]


def test_money_keeps_small_and_huge_amounts(spark):
    total = lambda *v: spark.createDataFrame([(x,) for x in v], "v double").agg(sm.money(F.col("v")).alias("s")).first().s
    assert total(0.004, 0.004, 0.004) == 0.012
    assert total(1e30, 1.0) == 1e30 + 1.0
    assert total(float("inf"), 1.0) == float("inf")
    assert total(None) == 0.0


def test_sweep_over_no_claims(spark):
    empty = spark.createDataFrame([], "Path_Sum long, Rule_Fraud int, Cost_to_Package double")
    assert au.contamination_sweep(empty, [0.05, 0.12]).collect() == []
