"""Findings to ranked scoreboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import grade
from auditlake.operators.findings import cap_by_severity, dedupe_best, rank_scoreboard
from auditlake.operators.scores import protocol_score, severity_counts


def scoreboard(findings: DataFrame, programs: DataFrame, dedupe: bool = True) -> DataFrame:
    """Dedupe, cap, count, score and rank.

    programs: program, source_verified, authority_kind, threshold, signers, guard_risk; programs
    without findings are ranked too.
    """
    kept = cap_by_severity(dedupe_best(findings, scope=["program"])) if dedupe else findings
    counts = severity_counts(kept, ["program"])
    names = ["critical", "high", "medium", "low", "info", "total"]
    joined = programs.join(counts, "program", "left").fillna(0, names)
    scored = joined.withColumn("score", protocol_score()).withColumn("grade", grade(F.col("score")))
    return rank_scoreboard(scored).select("rank", "program", "score", "grade", *names)
