"""Lookups with hot and missing keys equal a plain left join and are spread out."""

from pyspark.sql import functions as F

from claimsift.operators import features as ft, lookup
from claimsift.session import materialize


def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("p"), (F.col("id") % 50).cast("string"))
    )
    return spark.range(3000).select(key.alias("k"), F.col("id"), (F.col("id") * 2).alias("v"))


def figures(df):
    return df.where("k is not null").groupBy("k").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("_rows"))


def test_spread_join_equals_plain_join(spark):
    df = skewed(spark)
    plain = df.join(figures(df).drop("_rows"), "k", "left").select("k", "id", "v", "total")
    for hot_rows in (1, 500, 10**9):
        spread = lookup.attach_spread(df, figures(df), "k", "_rows", F.col("id"), hot_rows)
        assert sorted(map(repr, spread.collect())) == sorted(map(repr, plain.collect()))


def test_hot_rows_leave_one_partition(spark):
    df = skewed(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = lookup.attach_spread(df, figures(df), "k", "_rows", F.col("id"), 500)
        sizes = [r.n for r in spread.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)


def test_long_keys_and_counted_join(spark):
    df = skewed(spark).select(F.when(F.col("k") == "hot", F.lit(5)).otherwise(F.col("id") % 11).cast("long").alias("k"), "id", "v")
    stored = materialize(figures(df), "figures")
    few = lookup.attach_counted(df, stored, "k", "_rows", F.col("id")).select("id", "total")
    many = lookup.attach_counted(df, stored, "k", "_rows", F.col("id"), broadcast_rows=2).select("id", "total")
    assert sorted(few.collect()) == sorted(many.collect())


def test_patient_lookup_with_hot_patient(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_ROWS", 10)
    rows = [(f"T{i}", "P0" if i % 2 else f"P{i}", i % 4) for i in range(200)]
    claims = spark.createDataFrame(rows, "TransactionID string, PatientID string, Hospital_PIN long")
    got = {r.TransactionID: r for r in ft.attach_patients(claims, ft.patient_figures(claims)).collect()}
    assert len(got) == 200
    assert got["T1"].Patient_Claim_Count == 101 and got["T1"].Multi_Hospital
    assert got["T2"].Patient_Claim_Count == 1 and not got["T2"].Multi_Hospital
