"""Claim features: typed input, stays, delays, cost ratio, peer and patient figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from claimsift.functions.values import DATE_FORMATS, finite_or_null, nan_to_null, parse_iso, parse_layout, parse_timestamp, whole_days
from claimsift.operators import lookup
from claimsift.schema import BATCH_REQUIRED, CLAIM_TYPES, TIME_COLUMNS, check_profile, has
from claimsift.session import materialize


@dataclass(frozen=True)
class TimeLayout:
    """How a text column of times is read: its layout, and what that does to its cells."""

    layout: str | None
    cells: int
    read: int

    @property
    def misfits(self) -> int:
        return self.cells - self.read


def text_times(df: DataFrame) -> list[str]:
    """The time columns that a frame has as text."""
    return [f.name for f in df.schema.fields if f.name in TIME_COLUMNS and isinstance(f.dataType, T.StringType)]


def time_layouts(df: DataFrame) -> dict[str, TimeLayout]:
    """The one layout of each text column of times, from all its cells.

    One aggregate counts the cells that each layout fits; a cell with a day
    above 12 so decides between day first and month first. ISO cells are read
    beside any layout. Where two fit as many cells, the first in
    ``DATE_FORMATS`` is taken; a column without other dates has none.
    """
    names = text_times(df)
    if not names:
        return {}
    cells = df.select(*[F.nullif(F.btrim(F.col(name)), F.lit("")).alias(f"cell{k}") for k, name in enumerate(names)])
    # Each layout looks at the cells that are no ISO text only.
    others = {f"rest{k}": F.when(parse_iso(F.col(f"cell{k}")).isNull(), F.col(f"cell{k}")) for k in range(len(names))}
    counts = []
    for k in range(len(names)):
        counts += [F.count(f"cell{k}").alias(f"cells{k}"), F.count(f"rest{k}").alias(f"other{k}")]
        counts += [F.count(parse_layout(F.col(f"rest{k}"), x)).alias(f"fit{k}_{n}") for n, x in enumerate(DATE_FORMATS)]
    row = cells.withColumns(others).agg(*counts).first()
    found = {}
    for k, name in enumerate(names):
        fits = [row[f"fit{k}_{n}"] for n in range(len(DATE_FORMATS))]
        best = max(range(len(fits)), key=lambda n: (fits[n], -n))
        layout = DATE_FORMATS[best] if fits[best] else None
        found[name] = TimeLayout(layout, row[f"cells{k}"], row[f"cells{k}"] - row[f"other{k}"] + fits[best])
    return found


def layout_report(spark: SparkSession, found: dict[str, TimeLayout]) -> DataFrame:
    """One row per text column of times, with the cells that were not read."""
    rows = [(name, x.layout or "ISO", x.cells, x.read, x.misfits) for name, x in found.items()]
    return spark.createDataFrame(rows, "time_column string, layout string, cells long, read long, misfits long")


def parse_timestamps(df: DataFrame, layouts: dict[str, TimeLayout] | None = None) -> DataFrame:
    """The four time columns as timestamps, NULL where they do not parse.

    Each text column is read by one layout, inferred from all its cells unless
    it is given. A stream cannot be looked through: there, columns without a
    given layout are read as ISO text.
    """
    if layouts is None:
        layouts = {} if df.isStreaming else time_layouts(df)
    changed: dict[str, Column] = {}
    for field in df.schema.fields:
        if field.name not in TIME_COLUMNS:
            continue
        if isinstance(field.dataType, T.StringType):
            own = layouts.get(field.name)
            changed[field.name] = parse_timestamp(F.col(field.name), (own.layout,) if own and own.layout else ())
        elif not isinstance(field.dataType, T.TimestampType):
            changed[field.name] = F.col(field.name).cast("timestamp")
    return df.withColumns(changed) if changed else df


def typed(field: T.StructField) -> Column:
    """One column in the type the claims schema gives it; NaN and misfits are NULL.

    Hospital ids given as text stay text, whatever they look like; only the
    ``.0`` that a table of floating numbers leaves on whole ones is cut.
    """
    column, wanted = F.col(field.name), CLAIM_TYPES[field.name]
    if field.name == "Hospital_PIN" and isinstance(field.dataType, T.StringType):
        return F.nullif(F.regexp_replace(F.btrim(column), r"^([0-9]+)\.0+$", "$1"), F.lit(""))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        column = nan_to_null(column)
    if field.dataType == wanted:
        return column
    if isinstance(field.dataType, T.StringType) and isinstance(wanted, (T.IntegerType, T.LongType, T.DoubleType)):
        column = nan_to_null(column.try_cast("double"))
    return column.try_cast(wanted)


def typed_claims(df: DataFrame, profile: str = "app", layouts: dict[str, TimeLayout] | None = None) -> DataFrame:
    """P06, first half: known columns in their types, NaN turned into NULL.

    The batch profile refuses a frame without its columns; the app profile
    takes what is there, and later steps fill in defaults. ``layouts`` says how
    text columns of times are written, where that is known already.
    """
    check_profile(profile)
    missing = [c for c in BATCH_REQUIRED if c not in df.columns]
    if profile == "batch" and missing:
        raise ValueError(f"batch profile needs the columns {missing}")
    changed = {f.name: typed(f) for f in df.schema.fields if f.name in CLAIM_TYPES and f.name not in TIME_COLUMNS}
    return parse_timestamps(df.withColumns(changed) if changed else df, layouts)


def resolve_cost_col(df: DataFrame) -> str | None:
    """The column that holds the billed amount, if any."""
    for name in ("Final_Billed_Amount", "TreatmentCost"):
        if name in df.columns:
            return name
    return None


def los(df: DataFrame) -> Column:
    """Whole days of stay, 1 when the frame has no such times."""
    if has(df, "Admission_Timestamp", "Discharge_Timestamp"):
        return whole_days(F.col("Admission_Timestamp"), F.col("Discharge_Timestamp"))
    return F.lit(1).cast("long")


def preauth_delay(df: DataFrame) -> Column:
    """Whole days from request to approval, 0 when the frame lacks either."""
    if has(df, "PreAuth_Request_Date", "PreAuth_Approval_Date"):
        return whole_days(F.col("PreAuth_Request_Date"), F.col("PreAuth_Approval_Date"))
    return F.lit(0).cast("long")


def cost_to_package(df: DataFrame) -> Column:
    """Billed amount per package rate, a zero rate counting as 1."""
    cost = resolve_cost_col(df)
    if cost is None or not has(df, "Base_Package_Rate"):
        return F.lit(1.0)
    rate = F.col("Base_Package_Rate")
    return F.col(cost) / F.when(rate == 0, F.lit(1.0)).otherwise(rate)


def claim_ratios(df: DataFrame) -> DataFrame:
    """P02-P04 on one frame; no shuffle."""
    return df.withColumns(
        {"LOS": los(df), "PreAuth_Delay": preauth_delay(df), "Cost_to_Package": cost_to_package(df)}
    )


def exact_mean(column: Column) -> Column:
    """Mean that does not depend on row order.

    Amounts are summed as decimals with six places. Values beyond them (or an
    infinity) fall back to the plain floating mean of the group.
    """
    exact = column.try_cast(T.DecimalType(28, 6))
    beyond = F.count_if(column.isNotNull() & exact.isNull())
    return F.when(beyond > 0, F.avg(column)).otherwise(
        F.sum(exact).cast("double") / F.nullif(F.count(column), F.lit(0))
    )


def hospital_figures(claims: DataFrame, cost_col: str) -> DataFrame:
    """Mean billed amount per hospital, with the number of claims."""
    return (
        claims.where(F.col("Hospital_PIN").isNotNull())
        .groupBy("Hospital_PIN")
        .agg(exact_mean(F.col(cost_col)).alias("Hospital_Avg_Cost"), F.count(F.lit(1)).alias("_rows"))
    )


def patient_figures(claims: DataFrame) -> DataFrame:
    """A02 and the multi-hospital test of F05, in one aggregation per patient."""
    present = has(claims, "Hospital_PIN")
    hospital = F.col("Hospital_PIN") if present else F.lit(None).cast("long")
    return (
        claims.where(F.col("PatientID").isNotNull())
        .groupBy("PatientID")
        .agg(
            F.count("TransactionID").alias("Patient_Claim_Count"),
            (F.min(hospital) < F.max(hospital)).alias("Multi_Hospital"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )


def hospitals_per_patient(claims: DataFrame) -> DataFrame:
    """Distinct hospitals of each patient, missing ones not counted."""
    return (
        claims.where(F.col("PatientID").isNotNull())
        .groupBy("PatientID")
        .agg(F.count_distinct("Hospital_PIN").alias("Hospitals"))
    )


def spread_of(df: DataFrame) -> Column:
    """A column that varies within a hospital and within a patient."""
    names = ("TransactionID", "PatientID", "Hospital_PIN", "Final_Billed_Amount", "Age")
    return F.xxhash64(F.lit(0), *[F.col(c) for c in names if c in df.columns])


def store_hospital_figures(claims: DataFrame) -> DataFrame | None:
    """A01 written to the shared folder, or None where the frame has no such columns."""
    cost = resolve_cost_col(claims)
    if cost is None or not has(claims, "Hospital_PIN"):
        return None
    return materialize(hospital_figures(claims, cost), "hospitals")


def attach_hospitals(df: DataFrame, figures: DataFrame | None) -> DataFrame:
    """The hospital's mean on every claim; own cost where there is no hospital column."""
    if figures is None:
        cost = resolve_cost_col(df)
        own = F.col(cost) if cost else F.lit(0.0)
        return df.withColumn("Hospital_Avg_Cost", own)
    return lookup.attach_counted(df, figures, "Hospital_PIN", "_rows", spread_of(df))


def attach_patients(df: DataFrame, figures: DataFrame | None) -> DataFrame:
    """Claims of the patient, and whether at several hospitals."""
    if figures is None:
        return df.withColumns(
            {"Patient_Claim_Count": F.lit(1).cast("long"), "Multi_Hospital": F.lit(None).cast("boolean")}
        )
    return lookup.attach_spread(df, figures, "PatientID", "_rows", spread_of(df))


def countable(claims: DataFrame) -> bool:
    return has(claims, "PatientID", "TransactionID")


def derive_features(claims: DataFrame, hospitals: DataFrame | None = None, patients: DataFrame | None = None) -> DataFrame:
    """P02-P04, J01, J02 and the input of F05 for a whole typed claim table.

    Figures that are not given stay in the plan as aggregates: whoever does not
    use them (no rule does with the hospitals' means) does not pay for them.
    Stored means, broadcast as a rule, are looked up behind the patients' shuffle.
    """
    ratios = claim_ratios(claims)
    cost = resolve_cost_col(claims)
    if patients is None and countable(claims):
        patients = patient_figures(claims)
    if hospitals is None and cost is not None and has(claims, "Hospital_PIN"):
        means = hospital_figures(claims, cost)
        return attach_patients(lookup.attach_spread(ratios, means, "Hospital_PIN", "_rows", spread_of(ratios)), patients)
    return attach_hospitals(attach_patients(ratios, patients), hospitals)


def derive_sample_features(sample: DataFrame, claims: DataFrame, hospitals: DataFrame | None) -> DataFrame:
    """Features of a small sample, its figures taken from the whole table.

    ``sample`` is limited by its caller, so the set of its patients and their
    figures may be broadcast: the table is read once and only the claims of
    those patients are shuffled, combined before that.
    """
    ratios = attach_hospitals(claim_ratios(sample), hospitals)
    if not countable(claims):
        return attach_patients(ratios, None)
    wanted = F.broadcast(sample.select("PatientID").distinct())
    figures = patient_figures(claims.join(wanted, "PatientID", "left_semi"))
    return ratios.join(F.broadcast(figures.drop("_rows")), "PatientID", "left")


def feature_columns(df: DataFrame, profile: str) -> list[str]:
    """The model's columns, in the profile's order, those present."""
    cost = resolve_cost_col(df)
    if profile == "batch":
        wanted = [
            "Final_Billed_Amount",
            "Cost_to_Package",
            "LOS",
            "PreAuth_Delay",
            "Hospital_Avg_Cost",
            "Patient_Claim_Count",
            "Age",
        ]
    else:
        wanted = [
            cost,
            "LOS",
            "Cost_to_Package",
            "PreAuth_Delay",
            "Hospital_Avg_Cost",
            "Patient_Claim_Count",
            "Age",
        ]
    derived = {"Cost_to_Package", "LOS", "PreAuth_Delay", "Hospital_Avg_Cost", "Patient_Claim_Count"}
    return [c for c in wanted if c is not None and (c in derived or c in df.columns)]


def feature_values(names: list[str]) -> list[Column]:
    """The columns as doubles, missing and non-finite values as 0."""
    return [F.coalesce(finite_or_null(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in names]
