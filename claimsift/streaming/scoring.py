"""Judge a claim stream with a saved forest and a fixed cut.

Hospital and patient figures come from stored tables (a stream-static join);
nothing is fitted while the stream runs. A hospital or patient that the tables
lack counts as one with this claim only: its mean is the claim's own cost, its
claims are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimsift.operators import features as ft, forest as fo
from claimsift.plans.audit import judged, with_rules


def scored_stream(
    claims: DataFrame,
    forest: fo.Forest,
    cut: int,
    hospitals: DataFrame,
    patients: DataFrame,
    profile: str = "app",
    layouts: dict[str, ft.TimeLayout] | None = None,
) -> DataFrame:
    """Verdicts on streamed claims; the model's label is relative to the saved cut.

    ``layouts`` are those of earlier claims (``features.time_layouts``); text
    times without one are read as ISO.
    """
    typed = ft.typed_claims(claims, profile, layouts)
    looked_up = ft.attach_hospitals(ft.attach_patients(ft.claim_ratios(typed), patients), hospitals)
    cost = ft.resolve_cost_col(typed)
    own = F.col(cost) if cost else F.lit(0.0)
    known = looked_up.withColumns(
        {
            "Hospital_Avg_Cost": F.coalesce("Hospital_Avg_Cost", own),
            "Patient_Claim_Count": F.coalesce("Patient_Claim_Count", F.lit(1).cast("long")),
        }
    )
    scored = forest.with_path(with_rules(known, profile))
    return judged(scored.withColumn("ML_Anomaly", fo.anomaly_label(cut)), profile)
