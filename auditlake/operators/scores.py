"""Scores: severity counts, protocol/scan/verification/guard/health/token scores and bands.

Every score is a column expression over counts; counts come from one `groupBy` with partial
aggregation, so a hot program costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import clamp, int_div
from auditlake.functions.text import occurrences


def _count(cond) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


SEVERITY_SCHEMES = {
    # scheme: bucket -> predicate over the severity column
    "report": {"critical": lambda s: s == 5, "high": lambda s: s == 4, "medium": lambda s: s == 3, "low": lambda s: s <= 2},
    "service": {
        "critical": lambda s: s == 5, "high": lambda s: s == 4, "medium": lambda s: s == 3, "low": lambda s: s == 2,
        "info": lambda s: s <= 1,
    },
}
# Labels of the label-based scheme; anything else counts as info.
LABELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def severity_counts(findings: DataFrame, by: list[str], scheme: str = "service") -> DataFrame:
    """Counts per severity bucket; scheme 'report', 'service' or 'label'."""
    if scheme == "label":
        label = F.upper(F.col("severity_label"))
        parts = [_count(label == name).alias(name.lower()) for name in LABELS]
        parts.append(_count(~label.isin(*LABELS) | label.isNull()).alias("info"))
    else:
        buckets = SEVERITY_SCHEMES[scheme]
        parts = [_count(test(F.col("severity"))).alias(name) for name, test in buckets.items()]
    return findings.groupBy(*by).agg(*parts, F.count(F.lit(1)).alias("total"))


def protocol_score(
    critical="critical", high="high", medium="medium", low="low", verified="source_verified",
    authority="authority_kind", threshold="threshold", signers="signers", guard="guard_risk",
) -> Column:
    weak = (F.col(signers) > 0) & (F.try_divide(F.col(threshold), F.col(signers)) < 0.5)
    owner = (
        F.when(F.col(authority) == "SingleWallet", 20)
        .when(F.col(authority) == "Unknown", 25)
        .when((F.col(authority) == "Multisig") & weak, 10)
        .otherwise(0)
    )
    score = (
        F.lit(100) - F.col(critical) * 25 - F.col(high) * 15 - F.col(medium) * 5 - F.col(low) * 2
        - F.when(F.col(verified), 0).otherwise(15) - owner - int_div(F.col(guard), 4)
    )
    return clamp(score, 0, 100).cast("int")


def scan_risk(critical="critical", high="high", medium="medium", low="low", info="info") -> Column:
    total = F.col(critical) * 15 + F.col(high) * 8 + F.col(medium) * 4 + F.col(low) * 2 + F.col(info)
    return F.least(F.lit(100), total).cast("int")


# Risk bands (upper bound, name).
RISK_BANDS = ((20, "LOW"), (40, "MODERATE"), (60, "ELEVATED"), (80, "HIGH"))


def risk_level(risk: Column, bands=RISK_BANDS, highest: str = "CRITICAL") -> Column:
    out = F.lit(highest)
    for top, name in reversed(bands):
        out = F.when(risk <= top, F.lit(name)).otherwise(out)
    return out


def verify_score(critical="critical", high="high", medium="medium", rest="rest") -> Column:
    score = F.lit(100) - F.col(critical) * 25 - F.col(high) * 15 - F.col(medium) * 5 - F.col(rest)
    return clamp(score, 0, 100).cast("int")


def verify_tier(
    verified="source_verified", critical="critical", high="high", revoked="authority_revoked", upgradeable="is_upgradeable"
) -> Column:
    clean = F.col(critical) == 0
    fixed = F.col(revoked) | ~F.col(upgradeable)
    return (
        F.when(F.col(verified) & clean & (F.col(high) == 0) & fixed, "Gold")
        .when(F.col(verified) & clean & (F.col(high) <= 2), "Silver")
        .when(clean, "Bronze")
        .otherwise("Unverified")
    )


# Guard points per severity and the surcharge of a critical malicious package.
GUARD_POINTS = {"Critical": 25, "High": 15, "Medium": 5, "Low": 2}
GUARD_MALICIOUS = 25


def guard_risk(findings: DataFrame, by: list[str]) -> DataFrame:
    points = F.lit(0)
    for name, value in GUARD_POINTS.items():
        points = F.when(F.col("severity") == name, F.lit(value)).otherwise(points)
    extra = F.when((F.col("severity") == "Critical") & (F.col("category") == "KnownMalicious"), GUARD_MALICIOUS)
    total = F.sum(points + F.coalesce(extra, F.lit(0)))
    return findings.groupBy(*by).agg(F.least(total, F.lit(100)).cast("int").alias("guard_risk"))


# Fixed values: (weight, damping, cap) of the saturating penalties.
HEALTH = {"critical": (15.0, 0.2, 40.0), "high": (10.0, 0.3, 25.0), "medium": (5.0, 0.4, 15.0), "low": (2.0, 0.5, 8.0)}


def health_score(names=("critical", "high", "medium", "low"), penalties=HEALTH) -> Column:
    score = F.lit(100.0)
    for name in names:
        weight, damping, cap = penalties[name]
        n = F.col(name).cast("double")
        score = score - F.least(n * weight / (F.lit(1.0) + n * damping), F.lit(cap))
    return F.floor(clamp(score, 0.0, 100.0)).cast("int")


# Points per line share of each unsafe construct.
UNSAFE_WEIGHTS = {
    "unsafe_blocks": 1000, "unsafe_functions": 800, "ffi_calls": 600, "raw_pointers": 500, "transmute_calls": 700,
    "asm_blocks": 900, "unsafe_traits": 400,
}


def unsafe_score(lines: str = "total_lines", weights=UNSAFE_WEIGHTS) -> Column:
    score = F.lit(100.0)
    for name, weight in weights.items():
        score = score - F.try_divide(F.col(name).cast("double"), F.col(lines)) * weight
    return F.when(F.col(lines) == 0, F.lit(100)).otherwise(F.floor(clamp(score, 0.0, 100.0))).cast("int")


# Points per metric and per finding severity.
ANCHOR_METRICS = {
    "missing_signer_checks": -15.0, "missing_owner_checks": -12.0, "missing_pda_validation": -10.0,
    "missing_cpi_guards": -18.0, "weak_constraints": -8.0, "reinit_vulnerabilities": -20.0,
    "missing_close_guards": -10.0, "token_hook_implementations": 5.0, "custom_constraint_count": 2.0,
}
ANCHOR_FINDINGS = {"critical": -5.0, "high": -3.0, "medium": -1.0, "low": -0.5}


def anchor_score(metrics=ANCHOR_METRICS, findings=ANCHOR_FINDINGS) -> Column:
    score = F.lit(100.0)
    for name, points in {**metrics, **findings}.items():
        score = score + F.col(name) * points
    return F.floor(clamp(score, 0.0, 100.0)).cast("int")


SHORT_LOCK_SECONDS = 30 * 24 * 3600
# Points per token flag.
TOKEN_POINTS = {
    "can_mint": 20.0, "can_freeze": 10.0, "is_upgradeable": 10.0, "concentrated_supply": 10.0, "no_liquidity_lock": 7.0,
    "short_liquidity_lock": 3.0,
}
TOKEN_GRADES = ((10, "A+"), (20, "A"), (30, "B"), (40, "C"), (50, "D"), (70, "E"))


def token_flags(checks: DataFrame) -> DataFrame:
    """Six risk flags from the token's on-chain checks."""
    return checks.withColumns(
        {
            "can_mint": F.col("mint_authority").isNotNull(),
            "can_freeze": F.col("freeze_authority").isNotNull(),
            "concentrated_supply": F.col("top_holder_concentration") > 50.0,
            "no_liquidity_lock": ~F.col("liquidity_locked"),
            "short_liquidity_lock": F.coalesce(F.col("liquidity_lock_duration") < SHORT_LOCK_SECONDS, F.lit(False)),
        }
    )


def token_risk(checks: DataFrame, findings: DataFrame, key: str = "mint", points=TOKEN_POINTS) -> DataFrame:
    """Risk score, exit probability and grade per token; findings are counted before the join."""
    counts = findings.groupBy(key).agg(
        _count(F.col("severity") >= 4).alias("_severe"), _count(F.col("severity") == 3).alias("_medium")
    )
    df = token_flags(checks).join(counts, key, "left").fillna(0, ["_severe", "_medium"])
    score = F.least(F.col("_severe") * 8.0, F.lit(30.0)) + F.least(F.col("_medium") * 3.0, F.lit(10.0))
    for name, value in points.items():
        score = score + F.when(F.col(name), F.lit(value)).otherwise(F.lit(0.0))
    df = df.withColumn("risk_score", F.floor(F.least(score, F.lit(100.0))).cast("int"))
    base = F.col("risk_score") / 100.0
    minted = F.when(
        F.col("can_mint") & F.col("concentrated_supply"), F.least(base * 1.5, F.lit(0.99))
    ).otherwise(base)
    exit_p = F.when(
        F.col("is_upgradeable") & F.col("no_liquidity_lock"), F.least(minted * 1.3, F.lit(0.99))
    ).otherwise(minted)
    df = df.withColumn("rug_probability", F.round(exit_p, 2))
    return df.withColumn("grade", risk_level(F.col("risk_score"), TOKEN_GRADES, "F")).drop("_severe", "_medium")


def holder_concentration(balances: DataFrame, k: int, key: str = "mint", holder: str = "holder") -> DataFrame:
    """Per cent of a token's balance held by its k largest holders."""
    per_holder = balances.groupBy(key, holder).agg(F.sum("balance").alias("balance"))
    w = Window.partitionBy(key).orderBy(F.desc("balance"), F.asc(holder))
    top = (
        per_holder.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
        .groupBy(key).agg(F.sum("balance").alias("_top"))
    )
    total = balances.groupBy(key).agg(F.sum("balance").alias("_total"))
    share = F.coalesce(F.try_divide(F.col("_top"), F.col("_total")) * 100, F.lit(0.0))
    return total.join(top, key).select(key, share.cast("double").alias("top_holder_concentration"))


# Points per compatibility warning.
DIFFERENCE_POINTS = {"BREAKING": -15, "RISKY": -8, "INFO": -2}
DIFFERENCE_OTHER = -5
WARNING_POINTS = {
    "ComputeBudgetRisk": -10, "TransactionOrderingDependency": -12, "ClockResolutionAssumption": -5,
    "ConcurrentAccountAccess": -8, "SyscallMeteringDiff": -3,
}


def compat_score(warnings: DataFrame, by: list[str]) -> DataFrame:
    """warnings: kind ('RuntimeDifference' carries a difference severity), severity."""
    points = F.lit(0)
    for kind, value in WARNING_POINTS.items():
        points = F.when(F.col("kind") == kind, F.lit(value)).otherwise(points)
    diff = F.lit(DIFFERENCE_OTHER)
    for name, value in DIFFERENCE_POINTS.items():
        diff = F.when(F.col("severity") == name, F.lit(value)).otherwise(diff)
    points = F.when(F.col("kind") == "RuntimeDifference", diff).otherwise(points)
    return warnings.groupBy(*by).agg(clamp(F.lit(100) + F.sum(points), 0, 100).cast("int").alias("compat_score"))


# Compute units per occurrence.
COMPUTE_BASE = 5000
COMPUTE_COST = {
    "invoke(": 1000, "invoke_signed(": 1000, "CpiContext::new": 1000, "msg!": 100, "sol_log": 100,
    "find_program_address": 1500, "create_program_address": 1500, "sha256": 90, "keccak": 90, "hashv": 90,
    "serialize": 200, "try_to_vec": 200, "borsh::": 200,
}
COMPUTE_DELTA = {
    "copy_from_slice": 2, "sol_memcpy": 2, "sol_memmove": 2, "emit!": 5, "sol_log_data": 5, "sha256": 5, "keccak": 5,
}
LIMIT_MARKS = ("set_compute_unit_limit", "RequestUnitsDeprecated")
LIMIT_LINES = "set_compute_unit_limit|request_units"
DEFAULT_LIMIT = 200_000


def compute_budget(
    df: DataFrame, text: str = "code", cost=COMPUTE_COST, delta=COMPUTE_DELTA, marks=LIMIT_MARKS, lines=LIMIT_LINES,
    base: int = COMPUTE_BASE, default: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Estimated compute units, their change on the other client, margin and risk per unit."""
    col = F.col(text)

    def weigh(table):
        total = F.lit(0).cast("bigint")
        for token, units in table.items():
            total = total + occurrences(col, token) * units
        return total

    explicit = F.contains(col, F.lit(marks[0]))
    for mark in marks[1:]:
        explicit = explicit | F.contains(col, F.lit(mark))
    limit_lines = F.filter(F.split(col, "\n"), lambda x: x.rlike(lines))
    numbers = F.flatten(F.transform(limit_lines, lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1))))
    limits = F.filter(
        F.transform(numbers, lambda n: n.try_cast("bigint")), lambda n: (n > 1000) & (n <= F.lit(2**32 - 1))
    )
    limit = F.when(explicit, F.get(limits, F.lit(0)))
    out = df.withColumns(
        {"sets_limit": explicit, "cu_limit": limit, "cu_usage": F.lit(base) + weigh(cost), "cu_delta": weigh(delta)}
    )
    effective = F.coalesce(F.col("cu_limit"), F.lit(default)).cast("double")
    out = out.withColumn("margin_pct", (effective - (F.col("cu_usage") + F.col("cu_delta"))) / effective * 100)
    risk = (
        F.when(~F.col("sets_limit"), "Unknown").when(F.col("margin_pct") > 20, "Safe")
        .when(F.col("margin_pct") > 10, "Moderate").otherwise("High")
    )
    return out.withColumn("cu_risk", risk)


# Weight per flag severity and the sum that counts as full.
FLAG_WEIGHTS = {"Info": 1, "Low": 3, "Medium": 5, "High": 8, "Critical": 10}
FLAG_FULL = 320


def assessment_score_of_counts(counts: dict[str, Column], weights=FLAG_WEIGHTS, full: int = FLAG_FULL) -> Column:
    """The same from the number of flags of each severity, so that a target with many flags stays a few numbers."""
    total = sum((F.coalesce(n, F.lit(0)).cast("long") * weights.get(name, 0) for name, n in counts.items()), F.lit(0).cast("long"))
    return F.least(int_div(total * 100, full), F.lit(100)).cast("int")


def assessment_score(flags: Column, weights=FLAG_WEIGHTS, full: int = FLAG_FULL) -> Column:
    """Whole-number score of an array of flag severities."""
    def weight(x):
        out = F.lit(0)
        for name, value in weights.items():
            out = F.when(x == name, F.lit(value)).otherwise(out)
        return out

    total = F.aggregate(flags, F.lit(0), lambda acc, x: acc + weight(x))
    return F.least(int_div(total * 100, full), F.lit(100)).cast("int")


REPUTATION_STEP = 100
REPUTATION_CAP = 10_000


def confirm_assessments(assessments: DataFrame, confirms: DataFrame, analysts: DataFrame) -> DataFrame:
    """Confidence and status per assessment; self- and repeated confirmations do not count.

    assessments: target, analyst; confirms: target, analyst; analysts: analyst, reputation_bps.
    """
    owner = assessments.select("target", F.col("analyst").alias("_owner"))
    valid = confirms.select("target", "analyst").distinct().join(owner, "target").filter("analyst <> _owner")
    counts = valid.groupBy("target").agg(F.count(F.lit(1)).alias("_n"))
    df = (
        assessments.join(counts, "target", "left").join(analysts, "analyst", "left")
        .withColumn("confirmations", F.coalesce("_n", F.lit(0)).cast("bigint"))
    )
    rep = F.coalesce(F.col("reputation_bps"), F.lit(0))
    confidence = int_div(rep * 50, 10_000) + F.least(F.col("confirmations") * 10, F.lit(50))
    return df.select(
        "target", "analyst", "confirmations",
        F.least(confidence, F.lit(100)).cast("int").alias("confidence"),
        F.when(F.col("confirmations") >= 1, "Confirmed").otherwise("Pending").alias("status"),
    )


def reputation_after(confirmed: DataFrame, analysts: DataFrame, step: int = REPUTATION_STEP, cap: int = REPUTATION_CAP) -> DataFrame:
    """Reputation after the confirmations each analyst's assessments received."""
    gained = confirmed.groupBy("analyst").agg(F.sum("confirmations").alias("_n"))
    value = F.least(F.col("reputation_bps") + F.coalesce(F.col("_n"), F.lit(0)) * step, F.lit(cap))
    return analysts.join(gained, "analyst", "left").select("analyst", value.cast("int").alias("reputation_bps"))


# Weight per maturity signal, and of the typed-account share.
MATURITY = {
    "has_checked_math": 2.0, "has_safe_math_module": 1.5, "has_overflow_checks": 1.0, "has_error_handling": 1.5,
    "has_access_control": 2.0, "has_pda_validation": 2.0, "has_cpi_guards": 1.5, "has_oracle_staleness": 1.0,
    "has_slippage_protection": 1.5, "has_pause": 0.5, "has_events": 0.5, "has_reentrancy_guard": 1.0,
    "has_decimals": 0.5, "has_amm_invariant": 2.0, "has_u128": 1.5, "has_pda_signed": 2.0, "has_init_protected": 1.0,
}
MATURITY_TYPED = 2.0


def maturity(weights=MATURITY, typed: str = "typed_ratio", typed_weight: float = MATURITY_TYPED) -> Column:
    score = F.coalesce(F.col(typed), F.lit(0.5)) * typed_weight
    for name, value in weights.items():
        score = score + F.when(F.col(name), F.lit(value)).otherwise(F.lit(0.0))
    return score / (sum(weights.values()) + typed_weight)
