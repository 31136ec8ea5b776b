"""Lookup joins: knowledge base, advisories, controls, fixes, insights, risk by lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import clean_version, valid_program_id, version_listed


def enrich(findings: DataFrame, kb: DataFrame, fill: dict[str, str]) -> DataFrame:
    """Fill empty finding columns from the first knowledge-base row that lists the finding's id.

    kb: pos, detector_ids ARRAY<STRING>, and the columns named in fill {finding column: kb column}.
    """
    wanted = sorted(set(fill.values()))
    rows = kb.select("pos", F.explode("detector_ids").alias("id"), F.struct(*wanted).alias("_kb"))
    first = rows.groupBy("id").agg(F.min_by("_kb", "pos").alias("_kb"))
    joined = findings.join(first, "id", "left")
    for target, source in fill.items():
        kept = F.col(target)
        if dict(findings.dtypes)[target] == "string":
            kept = F.nullif(kept, F.lit(""))
        joined = joined.withColumn(target, F.coalesce(kept, F.col(f"_kb.{source}"), F.col(target)))
    return joined.select(*findings.columns)


def match_advisories(deps: DataFrame, advisories: DataFrame, carry=("severity", "title")) -> DataFrame:
    """Dependencies named by an advisory, version listed or '*', ecosystem equal or 'both'."""
    adv = advisories.select(
        F.lower("package").alias("_name"),
        F.lower("ecosystem").alias("_eco"),
        F.col("affected_versions").alias("_versions"),
        F.col("id").alias("advisory_id"),
        *[F.col(c).alias(f"advisory_{c}") for c in carry],
    )
    cond = (
        (F.lower(F.col("name")) == F.col("_name"))
        & ((F.col("_eco") == "both") | (F.col("_eco") == F.lower(F.col("ecosystem"))))
        & version_listed(
            F.when(F.lower(F.col("ecosystem")) == "npm", clean_version(F.col("version"))).otherwise(F.col("version")),
            F.col("_versions"),
        )
    )
    return deps.join(adv, cond).drop("_name", "_eco", "_versions")


def _controls(spark, catalogue) -> DataFrame:
    return spark.createDataFrame(
        [(f, c, n, list(ids)) for f, c, n, ids in catalogue],
        "framework string, control_id string, name string, detector_ids array<string>",
    )


def control_status(findings: DataFrame, catalogue: list[tuple], scope: list[str] | None = None) -> DataFrame:
    """One row per (scope, control): Fail when any mapped id occurs, else Pass.

    catalogue: (framework, control_id, name, detector ids). Findings are counted per id before they
    meet the catalogue, so the join sees one row per (scope, id).
    """
    scope = scope or []
    spark = findings.sparkSession
    per_id = findings.groupBy(*scope, "id").agg(F.count(F.lit(1)).alias("_n"))
    links = _controls(spark, catalogue).select("framework", "control_id", F.explode("detector_ids").alias("id"))
    failed = (
        per_id.join(F.broadcast(links), "id")
        .groupBy(*scope, "framework", "control_id")
        .agg(F.sum("_n").alias("n_findings"), F.count(F.lit(1)).alias("n_ids"))
    )
    if scope:
        every = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("framework", "control_id", "name"), c)])
                          for c in catalogue])
        names = findings.select(*scope).distinct().select(*scope, F.inline(every))
    else:
        names = _controls(spark, catalogue).drop("detector_ids")
    status = F.when(F.col("n_findings") > 0, "Fail").otherwise("Pass")
    return names.join(failed, [*scope, "framework", "control_id"], "left").select(
        *scope, "framework", "control_id", "name", status.alias("status"),
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        F.coalesce("n_ids", F.lit(0)).alias("n_ids"),
    )


def control_evidence(findings: DataFrame, catalogue: list[tuple]) -> DataFrame:
    """One evidence row per (finding, control) that the finding fails."""
    links = _controls(findings.sparkSession, catalogue).select(
        "framework", "control_id", F.explode("detector_ids").alias("id")
    )
    line = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("vuln_type"), F.lit(": "), F.col("description"))
    return findings.join(F.broadcast(links), "id").withColumn("evidence", line)


def compliance_score(status: DataFrame, by: list[str]) -> DataFrame:
    """Whole per cent of the applicable controls that pass."""
    passed = F.sum((F.col("status") == "Pass").cast("int"))
    usable = F.greatest(F.sum((F.col("status") != "NotApplicable").cast("int")), F.lit(1))
    return status.groupBy(*by).agg(
        passed.alias("passed"),
        F.sum((F.col("status") == "Fail").cast("int")).alias("failed"),
        F.floor(passed / usable * 100).cast("int").alias("compliance_score"),
    )


def deadline(severity: Column) -> Column:
    return (
        F.when(severity == 5, "Immediate").when(severity == 4, "7 days").when(severity == 3, "30 days")
        .otherwise("90 days")
    )


def suggest_fixes(findings: DataFrame, patterns: DataFrame, fixes: DataFrame) -> DataFrame:
    """id -> pattern -> fix text; findings without a pattern keep null."""
    table = patterns.join(fixes, "pattern", "left").select("id", "pattern", "fix")
    return findings.join(table, "id", "left")


def insights(findings: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Expert advice by id, left join on a small reference table."""
    return findings.join(table, key, "left")


# Transaction risk when the lookup knows nothing, and the limits of a safe one.
UNKNOWN_RISK = 50
SAFE_OVERALL = 40
RISKY_PROGRAM = 80


def assess_transactions(tx_programs: DataFrame, safe: DataFrame, scoreboard: DataFrame) -> DataFrame:
    """Risk per transaction: known-safe programs 0, scored ones 100 - score, others 50.

    tx_programs: tx_id, program_id; safe: program_id; scoreboard: program_id, score.
    """
    known = safe.select("program_id").distinct().withColumn("_safe", F.lit(True))
    scores = scoreboard.select("program_id", F.col("score").alias("_score"))
    valid = valid_program_id(F.col("program_id"))
    risk = (
        F.when(~valid, F.lit(UNKNOWN_RISK))
        .when(F.col("_safe"), F.lit(0))
        .when(F.col("_score").isNotNull(), F.greatest(F.lit(100) - F.col("_score"), F.lit(0)))
        .otherwise(F.lit(UNKNOWN_RISK))
    )
    each = (
        tx_programs.join(known, "program_id", "left")
        .join(scores, "program_id", "left")
        .withColumn("risk", risk)
    )
    overall = F.floor(F.sum("risk") / F.count(F.lit(1))).cast("int")
    return each.groupBy("tx_id").agg(
        F.count(F.lit(1)).alias("n_programs"),
        overall.alias("overall_risk"),
        F.max("risk").cast("int").alias("max_risk"),
        ((overall <= SAFE_OVERALL) & (F.max("risk") < RISKY_PROGRAM)).alias("is_safe"),
    )


# One-hop call risk by call type and its multipliers.
CALL_RISK = {"RawInvoke": 80, "InvokeSigned": 60, "AnchorCPI": 30}
CALL_RISK_OTHER = 50


def cpi_risk(edges: DataFrame, nodes: DataFrame, base=CALL_RISK, other: int = CALL_RISK_OTHER) -> DataFrame:
    """Risk of each call edge from its type and its callee; every step truncates and stays <= 100.

    edges: caller, callee, call_type; nodes: program_id, security_score, verified, is_upgradeable.
    """
    start = F.lit(other)
    for kind, value in base.items():
        start = F.when(F.col("call_type") == kind, F.lit(value)).otherwise(start)

    def step(col, cond, factor):
        raised = F.least(F.floor(col * F.lit(factor)), F.lit(100)).cast("int")
        return F.when(F.coalesce(cond, F.lit(False)), raised).otherwise(col)

    risk = step(start, ~F.col("verified"), 1.3)
    risk = step(risk, F.col("is_upgradeable"), 1.2)
    risk = step(risk, F.col("security_score") < 50, 1.4)
    callee = nodes.select(F.col("program_id").alias("callee"), "security_score", "verified", "is_upgradeable")
    return (
        edges.join(callee, "callee")
        .withColumn("risk", risk.cast("int"))
        .filter("risk > 20")
        .select("caller", "callee", "call_type", "risk")
    )


def to_findings(df: DataFrame, mapping: dict[str, Column], severity: dict[str, int], label: str) -> DataFrame:
    """Rows of another tool as findings: mapped columns plus a normalised severity."""
    rank = F.lit(1)
    for name, value in severity.items():
        rank = F.when(F.lower(F.col(label)) == name.lower(), F.lit(value)).otherwise(rank)
    return df.select(*[c.alias(n) for n, c in mapping.items()], rank.cast("int").alias("severity"))
