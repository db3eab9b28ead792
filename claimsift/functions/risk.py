"""Rules, score fusion, fraud type, tiers and explanations as columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from claimsift.functions import text as tx
from claimsift.functions.values import holds

# Thresholds and weights.
RATIO_LIMIT = 2.5
RATIO_WARNING = 2.0
RULE_WEIGHT, MODEL_WEIGHT, RATIO_WEIGHT = 0.5, 0.4, 0.1
FLAG_LIMIT = 0.5
MANY_CLAIMS = 2

# Names of the fraud types; the batch profile spells one differently.
GHOST = "Ghost Billing"
UPCODING = {"batch": "Upcoding", "app": "Up-coding"}
MISUSE = "Identity Misuse"
FAKE = "Fake Admission"
ANOMALOUS = "Anomalous Pattern"

# Fixed value: the explanation of a batch run that has no text model at hand.
NO_MODEL_TEXT = "AI disabled (no API key)"


def rule_zero_rate() -> Column:
    """billed although the package rate is zero."""
    return holds(F.col("Base_Package_Rate") == 0)


def rule_ratio() -> Column:
    """billed more than 2.5 times the package rate."""
    return holds(F.col("Cost_to_Package") > RATIO_LIMIT)


def rule_stay() -> Column:
    """a stay of no whole day, or a negative one."""
    return holds(F.col("LOS") <= 0)


def rule_gender() -> Column:
    """maternity care billed for a man."""
    return holds((F.col("Gender") == "Male") & (F.col("Primary_Diagnosis") == "Maternity Care"))


def rule_many_hospitals() -> Column:
    """the patient was seen at more than one hospital."""
    return holds(F.col("Multi_Hospital"))


def active_rules(columns: Iterable[str], profile: str) -> dict[str, Column]:
    """the rules that apply to a frame with these columns, by name."""
    present = set(columns)
    rules: dict[str, Column] = {}
    if "Base_Package_Rate" in present:
        rules["zero_rate"] = rule_zero_rate()
    rules["ratio"] = rule_ratio()
    rules["stay"] = rule_stay()
    if profile == "app" and {"Gender", "Primary_Diagnosis"} <= present:
        rules["gender"] = rule_gender()
    if profile == "batch":
        rules["many_hospitals"] = rule_many_hospitals()
    return rules


def rule_fraud(rules: dict[str, Column]) -> Column:
    """1 when any rule holds."""
    any_rule = F.lit(False)
    for predicate in rules.values():
        any_rule = any_rule | predicate
    return any_rule.cast("int")


def rule_names(rules: dict[str, Column]) -> Column:
    """names of the rules that hold, in a fixed order."""
    return F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in rules.items()]))


def risk_score(profile: str) -> Column:
    """Rule, model and ratio evidence combined."""
    score = (
        F.col("Rule_Fraud") * RULE_WEIGHT
        + (F.col("ML_Anomaly") == -1).cast("int") * MODEL_WEIGHT
        + holds(F.col("Cost_to_Package") > RATIO_WARNING).cast("int") * RATIO_WEIGHT
    )
    return F.round(score, 2) if profile == "app" else score


def fraud_flag() -> Column:
    """1 above half the scale."""
    return (F.col("Risk_Score") > FLAG_LIMIT).cast("int")


def suspicion_score() -> Column:
    """P10: risk on a scale of 0 to 100."""
    return F.round(F.col("Risk_Score") * 100, 0).cast("int")


def fraud_type(columns: Iterable[str], profile: str) -> Column:
    """X11: the first matching type; every row gets one, flagged or not."""
    zero_rate = rule_zero_rate() if "Base_Package_Rate" in set(columns) else F.lit(False)
    return (
        F.when(zero_rate, F.lit(GHOST))
        .when(rule_ratio(), F.lit(UPCODING[profile]))
        .when(holds(F.col("Patient_Claim_Count") > MANY_CLAIMS), F.lit(MISUSE))
        .when(rule_stay(), F.lit(FAKE))
        .otherwise(F.lit(ANOMALOUS))
    )


def justification(columns: Iterable[str], cost_col: str | None) -> Column:
    """One explanation per fraud type, empty for rows that are not flagged."""
    present = set(columns)

    def shown(name: str, fallback: str) -> Column:
        if name not in present:
            return F.lit(fallback)
        return F.coalesce(F.col(name).cast("string"), F.lit(fallback))

    amount = F.lit(tx.RUPEE + "0")
    if cost_col is not None:
        amount = F.coalesce(tx.rupees(F.col(cost_col)), F.lit(tx.RUPEE + "nan"))
    hospital = shown("Hospital_PIN", "?") if "Hospital_PIN" in present else shown("HospitalID", "?")
    words = {
        "amount": amount,
        "hospital": hospital,
        "patient": shown("PatientID", "?"),
        "age": shown("Age", "?"),
        "diagnosis": shown("Primary_Diagnosis", "Unknown"),
        "stay": shown("LOS", "?"),
        "ratio": tx.times(F.col("Cost_to_Package")),
        "risk": tx.plain_number(F.col("Risk_Score"), 2),
    }
    kind = F.col("Fraud_Type")
    by_type = (
        F.when(kind == GHOST, fill(TEMPLATES[GHOST], words))
        .when(kind == UPCODING["app"], fill(TEMPLATES[UPCODING["app"]], words))
        .when(kind == FAKE, fill(TEMPLATES[FAKE], words))
        .when(kind == MISUSE, fill(TEMPLATES[MISUSE], words))
        .otherwise(fill(TEMPLATES[ANOMALOUS], words))
    )
    return F.when(F.col("Fraud_Flag") == 1, by_type).otherwise(F.lit(""))


def fill(template: str, words: dict[str, Column]) -> Column:
    """A template with {name} slots as one concat of literals and columns."""
    pieces: list[Column] = []
    for part in template.replace("}", "{").split("{"):
        if part in words:
            pieces.append(words[part])
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


# The explanation texts, one per fraud type.
TEMPLATES = {
    GHOST: (
        "GHOST BILLING DETECTED — Hospital {hospital} submitted {amount} for patient {patient} "
        "(Age: {age}, Dx: {diagnosis}), but the base package rate is ₹0 — no legitimate procedure "
        "was registered. Under AB guidelines, a zero package rate triggers immediate claim rejection "
        "and potential hospital de-empanelment. Freeze payment and schedule field verification."
    ),
    UPCODING["app"]: (
        "UP-CODING FRAUD DETECTED — Billed {amount} at hospital {hospital} is {ratio} "
        "the approved package rate for '{diagnosis}'. The scheme caps claims at 2.5x base rate; "
        "this breach indicates deliberate billing for a higher-complexity procedure than was performed. "
        "Risk Score: {risk}/1.00. Request procedure records & discharge summary for cross-verification."
    ),
    FAKE: (
        "FAKE ADMISSION — Patient {patient} (Age: {age}) at hospital {hospital} has LOS of {stay} days "
        "(zero or negative) yet {amount} was billed for '{diagnosis}'. Records appear fabricated to "
        "trigger reimbursement without actual treatment. Verify admission/discharge records directly "
        "with the hospital and cross-check with the patient."
    ),
    MISUSE: (
        "IDENTITY MISUSE — PatientID {patient} (Age: {age}) appears across multiple claims, suggesting "
        "the same identity is being reused to generate repeated reimbursements. The current claim of "
        "{amount} for '{diagnosis}' at hospital {hospital} is part of a serial billing pattern. "
        "Audit all claims under {patient}, verify Aadhaar linkage, and check for simultaneous admissions."
    ),
    ANOMALOUS: (
        "ANOMALOUS PATTERN — ML model flagged patient {patient} (Age: {age}) at hospital {hospital} "
        "with risk score {risk}/1.00. Billed {amount}, LOS {stay} days for '{diagnosis}' deviates "
        "significantly from peer benchmarks. Possible service bundling, unnecessary procedures, or "
        "inflated consumables. Request itemised billing and clinical notes for review."
    ),
}

# Fixed value: the question put to a text model about one claim.
PROMPT = (
    "You are auditing a health-insurance claim.\n\n"
    "Age: {age}\nDiagnosis: {diagnosis}\nCost: ₹{cost}\nPackage Rate: {rate}\n"
    "Length of Stay: {stay} days\nFraud Type: {kind}\n"
    "Don't use emojis.\nDon't include hospital/patient IDs.\n"
    "Just give the core reason in one simple sentence.\n"
    "Explain briefly why this claim looks suspicious."
)


def llm_prompt() -> Column:
    """The prompt column of a batch claim, for a text model run elsewhere."""
    names = {
        "age": "Age",
        "diagnosis": "Primary_Diagnosis",
        "cost": "Final_Billed_Amount",
        "rate": "Base_Package_Rate",
        "stay": "LOS",
        "kind": "Fraud_Type",
    }
    words = {k: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for k, c in names.items()}
    for k in ("cost", "rate"):
        words[k] = F.coalesce(tx.float_text(F.col(names[k])), F.lit("nan"))
    return fill(PROMPT, words)


def fallback_justification(explanation: Column, cost: Column, kind: Column, risk: Column) -> Column:
    """The explanation, or a short stand-in where it is blank.

    In the stand-in a missing amount or risk counts as 0, a missing type is "nan".
    """
    clean = tx.strip_ends(F.coalesce(explanation, F.lit("")))
    stand_in = F.concat(
        tx.rupees(F.coalesce(cost, F.lit(0.0))),
        F.lit(" flagged — "),
        F.coalesce(kind, F.lit("nan")),
        F.lit(". Risk: "),
        tx.plain_number(F.coalesce(risk, F.lit(0.0)), 2),
        F.lit(". Manual review needed."),
    )
    return F.when(clean == "", stand_in).otherwise(clean)


def risk_tier(score: Column) -> Column:
    """Tier of a 0-100 suspicion score."""
    return (
        F.when(score >= 70, F.lit("High Risk")).when(score >= 40, F.lit("Investigating")).otherwise(F.lit("Safe"))
    )


def sensitivity_label(contamination: Column) -> Column:
    """Name of a contamination setting."""
    return (
        F.when(contamination < 0.08, F.lit("Conservative"))
        .when(contamination < 0.16, F.lit("Balanced"))
        .otherwise(F.lit("Aggressive"))
    )
