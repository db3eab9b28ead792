"""Claims in, judged claims out: the audit and the queries that stand on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from claimsift.functions import risk
from claimsift.operators import features as ft, forest as fo, summaries as sm
from claimsift.schema import CLAIM_TYPES, CONTAMINATION, FRAUD_COLUMNS, REPORT_COLUMNS, SEED, TREES, check_profile
from claimsift.session import materialize
from claimsift.sources.files import load_first_nonempty, read_claims_csv
from claimsift.sources.tables import ClaimStore

# Input columns the report and its rules need; times are used up by the features.
REPORT_INPUT = [
    "TransactionID",
    "PatientID",
    "Hospital_PIN",
    "Age",
    "Primary_Diagnosis",
    "Final_Billed_Amount",
    "Base_Package_Rate",
]


# Input columns beside the tables' own that an upload's verdicts and their texts read.
UPLOAD_INPUT = ["TransactionID", "PatientID", "Hospital_PIN", "HospitalID", "Age", "Primary_Diagnosis", "Disease", "Base_Package_Rate"]

# What the verdicts read of the features, rules and scores.
VERDICT_INPUT = ["LOS", "Cost_to_Package", "Patient_Claim_Count", "Rule_Fraud", "Path_Sum"]

# What the sweeps read of the scored claims.
SWEPT = ["Path_Sum", "Rule_Fraud", "Cost_to_Package"]


@dataclass(frozen=True)
class Settings:
    """Detection settings of a run."""

    profile: str = "app"
    contamination: float = CONTAMINATION
    trees: int = TREES
    seed: int = SEED

    def __post_init__(self) -> None:
        check_profile(self.profile)
        if not 0 < self.contamination <= 0.5:
            raise ValueError("contamination must lie in (0, 0.5]")


def ruled_claims(claims: DataFrame, profile: str = "app") -> DataFrame:
    """Typed claims with features, ``Rule_Fraud`` and the names of the rules."""
    typed = ft.typed_claims(claims, profile)
    return with_rules(ft.derive_features(typed), profile)


def with_rules(featured: DataFrame, profile: str) -> DataFrame:
    """the rules of a profile over derived features."""
    rules = risk.active_rules(featured.columns, profile)
    return featured.withColumns({"Rule_Fraud": risk.rule_fraud(rules), "Rules": risk.rule_names(rules)})


def judged(ruled: DataFrame, profile: str) -> DataFrame:
    """The verdict on claims that carry ``ML_Anomaly``."""
    check_profile(profile)
    scored = ruled.withColumn("Risk_Score", risk.risk_score(profile)).withColumns(
        {
            "Risk score per claim": F.col("Risk_Score"),
            "Fraud_Flag": risk.fraud_flag(),
            "Suspicion_Score": risk.suspicion_score(),
            "Fraud_Type": risk.fraud_type(ruled.columns, profile),
        }
    )
    if profile == "app":
        text = risk.justification(ruled.columns, ft.resolve_cost_col(ruled))
    else:
        text = F.when(F.col("Fraud_Flag") == 1, F.lit(risk.NO_MODEL_TEXT)).otherwise(F.lit(""))
    return scored.withColumn("AI_Justification", text)


def rules_only(claims: DataFrame, profile: str = "app") -> DataFrame:
    """The audit with the model off: no claim counts as an anomaly."""
    return judged(ruled_claims(claims, profile).withColumn("ML_Anomaly", F.lit(1)), profile)


def fit(claims: DataFrame, settings: Settings, hospitals: DataFrame | None = None) -> fo.Forest:
    """A forest for a claim table.

    Only the claims of the pool get features; their figures come from the
    whole table.
    """
    typed = ft.typed_claims(claims, settings.profile)
    typed = typed.select(*[c for c in typed.columns if c in CLAIM_TYPES])
    if hospitals is None:
        hospitals = ft.store_hospital_figures(typed)
    pool = fo.sample_pool(typed, settings.trees * fo.TREE_ROWS, settings.seed)
    sampled = ft.derive_sample_features(pool, typed, hospitals)
    names = ft.feature_columns(sampled, settings.profile)
    return fo.fit_forest(sampled, pool.count(), names, settings.trees, settings.seed)


def scored_claims(
    claims: DataFrame,
    settings: Settings,
    keep: list[str] | None = None,
    forest: fo.Forest | None = None,
    trees: list[int] | None = None,
    columns: list[str] | None = None,
    hospitals: DataFrame | None = None,
    patients: DataFrame | None = None,
) -> DataFrame:
    """Claims with features, rules and ``Path_Sum``, written once.

    The quantile and every later step read the written table, so the model
    runs once per claim. ``keep`` names the input columns to carry along.
    ``trees`` asks for ``Path_Sums`` as well: those over so many first trees.
    ``columns`` names the features, rules and scores to carry, all by default:
    what nobody reads is neither shuffled nor written. ``hospitals`` and
    ``patients`` are the claims' figures where they are stored already.
    """
    typed = ft.typed_claims(claims, settings.profile)
    if hospitals is None:
        hospitals = ft.store_hospital_figures(typed)
    if forest is None:
        forest = fit(typed, settings, hospitals)
    featured = with_rules(ft.derive_features(typed, hospitals, patients), settings.profile)
    if trees:
        scored = forest.with_paths(featured, [*trees, forest.trees])
        scored = scored.withColumn("Path_Sum", F.col(f"Path_Sums.trees_{forest.trees}"))
    else:
        scored = forest.with_path(featured)
    scored = scored.withColumn("Anomaly_Score", forest.anomaly_score())
    asked = {True: keep, False: columns}
    wanted = [c for c in scored.columns if (names := asked[c in typed.columns]) is None or c in names]
    return materialize(scored.select(*wanted), "scored")


def audited(
    claims: DataFrame, settings: Settings = Settings(), keep: list[str] | None = None, columns: list[str] | None = None
) -> DataFrame:
    """E01 without the final selection: every claim with its verdict.

    ``keep`` and ``columns`` are those of ``scored_claims``.
    """
    scored = scored_claims(claims, settings, keep, columns=columns)
    cut = fo.path_cut(scored, settings.contamination)
    return judged(scored.withColumn("ML_Anomaly", fo.anomaly_label(cut)), settings.profile)


def fraud_report(verdicts: DataFrame) -> DataFrame:
    """Flagged claims in the report's columns."""
    return sm.flagged(verdicts).select(*REPORT_COLUMNS)


def audit_report(claims: DataFrame, settings: Settings = Settings(profile="batch")) -> DataFrame:
    """The report of a batch run."""
    return fraud_report(audited(claims, settings, keep=REPORT_INPUT))


def contamination_sweep(scored: DataFrame, contaminations: list[float], profile: str = "app") -> DataFrame:
    """Anomalies and flagged claims per contamination.

    Scores do not depend on the contamination, so all settings are read off
    one histogram of the scored table.
    """
    return swept(scored.select("Path_Sum", "Rule_Fraud", "Cost_to_Package"), contaminations, profile)


def settings_sweep(scored: DataFrame, trees: list[int], contaminations: list[float], profile: str = "app") -> DataFrame:
    """Anomalies and flagged claims per number of trees and contamination.

    ``scored`` carries ``Path_Sums`` over each of ``trees`` (see
    ``scored_claims``): the model has run once, and each number of trees is one
    histogram. What is counted is what a run with those settings would flag.
    """
    sums = [F.struct(F.lit(n).alias("Trees"), F.col(f"Path_Sums.trees_{n}").alias("Path_Sum")) for n in trees]
    tall = scored.select("Rule_Fraud", "Cost_to_Package", F.inline(F.array(*sums)))
    return swept(tall, contaminations, profile, "Trees")


def swept(scored: DataFrame, contaminations: list[float], profile: str, *by: str) -> DataFrame:
    """The counts of every contamination, for each value of ``by`` apart."""
    over = F.coalesce(F.col("Cost_to_Package") > risk.RATIO_WARNING, F.lit(False))
    grouped = scored.select("Path_Sum", "Rule_Fraud", over.alias("Over"), *by)
    # Small and read twice: for the cuts and for the counts.
    histogram = materialize(fo.path_histogram(grouped, "Rule_Fraud", "Over", *by), "histogram")
    cuts = fo.path_cuts(histogram, contaminations, *by)
    if by:
        spread = histogram.join(cuts, list(by))
    else:
        # No claims, no cuts: the array is empty, and so is the result.
        listed = [F.struct(F.lit(r.Contamination).alias("Contamination"), F.lit(r.Path_Cut).alias("Path_Cut")) for r in cuts.collect()]
        listed = F.array(*listed) if listed else F.array().cast("array<struct<Contamination:double,Path_Cut:long>>")
        spread = histogram.select("*", F.inline(listed))
    spread = spread.withColumn(
        "ML_Anomaly", F.when(F.col("Path_Sum") < F.col("Path_Cut"), F.lit(-1)).otherwise(F.lit(1))
    ).withColumn("Cost_to_Package", F.when(F.col("Over"), F.lit(3.0)).otherwise(F.lit(1.0)))
    marked = spread.withColumn("Risk_Score", risk.risk_score(profile)).withColumn("Fraud_Flag", risk.fraud_flag())
    return (
        marked.groupBy(*by, "Contamination")
        .agg(
            F.sum("n").alias("Claims"),
            sm.total(F.when(F.col("ML_Anomaly") == -1, F.col("n"))).alias("Anomalies"),
            sm.total(F.when(F.col("Fraud_Flag") == 1, F.col("n"))).alias("Flagged"),
        )
        .withColumn("Sensitivity", risk.sensitivity_label(F.col("Contamination")))
    )


def queue_context(cases: DataFrame, top: int = 5) -> DataFrame:
    """The case queue as one row of text for an assistant."""
    counts = cases.groupBy("Fraud_Type").agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "Fraud_Type", "n"))).alias("kinds")
    ).select(
        F.concat_ws(", ", F.transform("kinds", lambda k: F.concat(F.lit("'"), k.Fraud_Type, F.lit("': "), k.n)))
    )
    cards = sm.top_cases(cases, top).select(
        F.struct(
            (-F.col("Risk_Score")).alias("o"),
            "PatientID",
            F.concat(
                F.col("PatientID"),
                F.lit(" "),
                F.col("Fraud_Type"),
                F.lit(" ₹"),
                F.format_number("Final_Billed_Amount", 0),
            ).alias("line"),
        ).alias("case")
    )
    best = cards.agg(F.array_sort(F.collect_list("case")).alias("cases")).select(
        F.concat_ws("; ", F.transform("cases", lambda c: c.line))
    )
    summary = sm.audit_summary(cases)
    text = F.concat(
        F.lit("You are the forensic auditor. The current audit queue has "),
        F.col("Cases").cast("string"),
        F.lit(" cases with a total suspicious value of "),
        F.col("Total_Label"),
        F.lit(". Common patterns: {"),
        kinds.scalar(),
        F.lit("}. Top cases: ["),
        best.scalar(),
        F.lit("]. Answer accurately and clinically."),
    )
    empty = F.lit("You are the forensic auditor. No fraud cases in queue.")
    return summary.select("Cases", F.when(F.col("Cases") > 0, text).otherwise(empty).alias("Context"))


def audit_page(cases: DataFrame) -> dict[str, DataFrame]:
    """Summary, type counts, newest alerts and cards of the audit page."""
    return {
        "summary": sm.audit_summary(cases),
        "types": sm.fraud_type_counts(cases),
        "alerts": sm.top_cases(cases, 3).select("PatientID", "Fraud_Type"),
        "cards": sm.case_cards(sm.fraud_queue(cases)),
    }


def startup_audit(store: ClaimStore, csv_path: str, uid: str | None, settings: Settings = Settings()) -> DataFrame | None:
    """Audit a user's stored claims, else a CSV file, else nothing."""
    claims = load_first_nonempty(
        [lambda: store.read("claims", uid) if uid else None, lambda: read_claims_csv(store.spark, csv_path)]
    )
    return None if claims is None else audited(claims, settings)


def settings_event(store: ClaimStore, settings: Settings, event_id: str, now: Column, uid: str = "guest") -> int:
    """Log that a run used other settings."""
    told = f"Updated sensitivity to {settings.contamination} and trees to {settings.trees}."
    event = store.spark.range(1).select(
        F.lit(event_id).alias("id"),
        F.lit(uid).alias("uid"),
        F.lit("Pipeline Configuration").alias("action"),
        F.lit(told).alias("description"),
    )
    return store.log_audit_events(event, now)


def process_upload(
    store: ClaimStore,
    batch: DataFrame,
    batch_id: str,
    filename: str,
    now: Column,
    uid: str | None = None,
    settings: Settings = Settings(),
    stored: bool = False,
) -> dict[str, object]:
    """Audit a batch, then store its claims, results, cases, session and log entry.

    Every step can be repeated under the same ``batch_id`` without doubling rows,
    and the counts logged are those of the first run's decision. The verdicts
    are read off the scored claims, which are written with the columns that the
    tables and the verdicts' texts have a use for. ``stored`` says that the
    batch is read off files (see ``ClaimStore.append_new``).
    """
    cost = ft.resolve_cost_col(batch)
    used = {*UPLOAD_INPUT, *VERDICT_INPUT, *FRAUD_COLUMNS, *store.schema("claims").names, cost}
    verdicts = audited(batch, settings, keep=[c for c in batch.columns if c in used], columns=VERDICT_INPUT)
    kpis = sm.batch_kpis(verdicts, cost).first()
    counts = store.append_new("claims", batch, now, user_id=uid, batch_id=batch_id, stored=stored)
    # Whatever the batch is, its verdicts are read off files.
    store.upsert("claims", verdicts, now, user_id=uid, stored=True)
    store.upsert_detected_frauds(sm.flagged(verdicts), now, cost, user_id=uid, stored=True)
    spark = store.spark
    session = spark.range(1).select(
        F.lit(batch_id).alias("id"),
        F.lit(uid).cast("string").alias("uid"),
        F.lit(filename).alias("filename"),
        F.lit(kpis.Total_Rows).alias("total_rows"),
        F.lit(counts["new"]).alias("new_rows"),
        F.lit(counts["skipped"]).alias("skipped_rows"),
        F.lit(kpis.Fraud_Found).alias("fraud_detected"),
        F.lit(kpis.Suspicious).alias("suspicious_amt"),
    )
    store.log_upload_sessions(session, now)
    told = f"Processed {kpis.Total_Rows} rows from {filename}. Detected {kpis.Fraud_Found} frauds."
    event = spark.range(1).select(
        F.lit(batch_id).alias("id"),
        F.lit(uid).cast("string").alias("uid"),
        F.lit("Batch Analysis").alias("action"),
        F.lit(told).alias("description"),
        F.lit(kpis.Suspicious).alias("amount"),
    )
    store.log_audit_events(event, now)
    return {**counts, **kpis.asDict()}
