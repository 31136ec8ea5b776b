"""Quality of a scan against ground truth: precision, recall, F1, per detector, expected bugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.findings import match_expected


def verdict(
    category: Column, severity: Column, confidence: Column, rule: Column, expected: Column, function: Column,
    flash_rule: str = "SOL-017",
) -> Column:
    """TP, FP or INFO from the program's category and the finding's strength."""
    strong = lambda floor: (severity >= 4) & (confidence >= floor)
    medium = severity >= 3
    hit = F.coalesce(F.array_contains(expected, rule), F.lit(False))
    flash = (rule == flash_rule) & F.contains(F.lower(function), F.lit("flash"))
    exploited = F.when(hit | strong(60), "TP").when(medium, "INFO").otherwise("FP")
    clean = F.when(strong(70), "FP").when(medium, "INFO").otherwise("FP")
    other = F.when(strong(65), "TP").when(medium, "INFO").otherwise("FP")
    return (
        F.when(F.coalesce(flash, F.lit(False)), "TP").when(category == "EXPLOITED", exploited)
        .when(category == "CLEAN", clean).otherwise(other)
    )


def classify_findings(findings: DataFrame, programs: DataFrame) -> DataFrame:
    """programs: program, category, expected_detections ARRAY<STRING>."""
    p = programs.select(
        "program", F.col("category").alias("_cat"), F.col("expected_detections").alias("_exp")
    )
    label = verdict(
        F.col("_cat"), F.col("severity"), F.col("confidence"), F.col("id"), F.col("_exp"), F.col("function_name")
    )
    return findings.join(p, "program").withColumn("verdict", label).drop("_cat", "_exp")


def evaluate(findings: DataFrame, programs: DataFrame) -> DataFrame:
    """Precision, recall over statically detectable exploits, F1 (per cent, one decimal)."""
    labelled = classify_findings(findings, programs)
    totals = labelled.agg(
        F.sum((F.col("verdict") == "TP").cast("bigint")).alias("tp"),
        F.sum((F.col("verdict") == "FP").cast("bigint")).alias("fp"),
        F.sum((F.col("verdict") == "INFO").cast("bigint")).alias("info"),
    )
    static = programs.filter("category = 'EXPLOITED' and not semantic_exploit and size(expected_detections) > 0")
    wanted = static.select("program", F.explode("expected_detections").alias("id"))
    hit = (
        findings.select("program", "id").join(wanted, ["program", "id"], "left_semi")
        .select("program", F.lit(1).alias("_hit")).distinct()
    )
    recall = static.join(hit, "program", "left").agg(
        F.count(F.lit(1)).alias("static_exploited"), F.count("_hit").alias("static_detected")
    )
    names = ("tp", "fp", "info", "static_exploited", "static_detected")
    both = totals.unionByName(recall, allowMissingColumns=True).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
    )
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("static_detected"), F.col("static_exploited")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return both.select(
        *names, F.round(p * 100, 1).alias("precision"), F.round(r * 100, 1).alias("recall"),
        F.round(f1 * 100, 1).alias("f1"),
    )


def per_detector(labelled: DataFrame) -> DataFrame:
    """Precision per rule id (1.0 without TP or FP), busiest rule first."""
    tp = F.sum((F.col("verdict") == "TP").cast("bigint"))
    fp = F.sum((F.col("verdict") == "FP").cast("bigint"))
    return (
        labelled.groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("total"), tp.alias("tp"), fp.alias("fp"),
            F.sum((F.col("verdict") == "INFO").cast("bigint")).alias("info"),
            F.round(F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)), 4).alias("precision"),
        )
        .orderBy(F.desc("total"), "id")
    )


def recall_by_program(findings: DataFrame, expected: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Share of expected bugs found per program, and whether it reaches the program's floor."""
    found = match_expected(findings, expected).groupBy("program").agg(F.count(F.lit(1)).alias("_f"))
    out = (
        expected.groupBy("program").agg(F.count(F.lit(1)).alias("expected"))
        .join(found, "program", "left")
        .withColumn("found", F.coalesce("_f", F.lit(0)))
        .withColumn("recall", F.round(F.col("found") / F.col("expected") * 100, 1))
        .drop("_f")
    )
    if floors is not None:
        out = out.join(floors, "program", "left").withColumn(
            "passes", F.col("recall") >= F.coalesce(F.col("floor"), F.lit(0.0))
        )
    return out
