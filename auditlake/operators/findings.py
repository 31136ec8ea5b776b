"""Operators over the finding table: dedupe, filters, grouping, confidence, caps, limits.

"First" and "earliest" follow an explicit `seq` column (any orderable type), never row arrival.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import clamp
from auditlake.functions.text import basename, has, has_any
from auditlake.operators.ordered import global_rank


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the first by order. Spark trims each map task to one row per key
    before the shuffle (window group limit), so a hot key never travels whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dedupe_best(findings: DataFrame, seq: str = "seq", scope: list[str] | None = None) -> DataFrame:
    """Highest confidence per (type, location, line), or per function where the line is 0."""
    place = F.when(F.col("line_number") > 0, F.concat(F.lit("L"), F.col("line_number"))).otherwise(
        F.concat(F.lit("F"), F.col("function_name"))
    )
    keyed = findings.withColumn("_place", place)
    keys = [*(scope or []), "vuln_type", "location", "_place"]
    return keep_first(keyed, keys, [F.desc("confidence"), F.asc(seq)]).drop("_place")


def dedupe_first(findings: DataFrame, seq: str = "seq", scope: list[str] | None = None) -> DataFrame:
    """First finding per (id, location)."""
    return keep_first(findings, [*(scope or []), "id", "location"], [F.asc(seq)])


def dedupe_fingerprint(df: DataFrame, fingerprint: Column, seq: str = "seq") -> DataFrame:
    return keep_first(df.withColumn("_fp", fingerprint), ["_fp"], [F.asc(seq)]).drop("_fp")


# Most findings kept per severity.
SEVERITY_LIMITS = {5: 15, 4: 20, 3: 15, 2: 10, 1: 5}
OTHER_LIMIT = 15


def cap_by_severity(
    findings: DataFrame, limits=SEVERITY_LIMITS, other: int = OTHER_LIMIT, by=("program",), seq: str = "seq"
) -> DataFrame:
    """Top findings per severity by confidence. The constant bound lets Spark trim before the shuffle."""
    limit = F.lit(other)
    for severity, n in limits.items():
        limit = F.when(F.col("severity") == severity, F.lit(n)).otherwise(limit)
    w = Window.partitionBy(*by, "severity").orderBy(F.desc("confidence"), F.asc(seq))
    most = max([*limits.values(), other])
    ranked = findings.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)
    return ranked.filter(F.col("_rn") <= limit).drop("_rn")


# Path parts of files that hold no program code.
NON_PROGRAM_PARTS = (
    "test", "bench", "build.rs", "examples", "mock", "fixture", "migration", "scripts", "knowledge_base",
    "vulnerability_db", "vuln_knowledge", "finding_validator", "metrics", "phase_timing", "cli", "tui",
)


def non_program(location: Column, parts=NON_PROGRAM_PARTS) -> Column:
    lower = F.lower(location)
    return (lower == "main.rs") | has_any(lower, parts)


def drop_non_program(findings: DataFrame, location: str = "location", parts=NON_PROGRAM_PARTS) -> DataFrame:
    return findings.filter(~non_program(F.col(location), parts))


def min_severity(findings: DataFrame, *floors: int) -> DataFrame:
    """Floor is the highest of the configured ones."""
    return findings.filter(F.col("severity") >= max(floors))


def min_confidence(findings: DataFrame, floor: int = 55) -> DataFrame:
    return findings.filter(F.col("confidence") >= floor)


def suppress(findings: DataFrame, ids=(), paths=(), functions=()) -> DataFrame:
    """Drop findings with a listed id, a path part, or a function name (exact, or prefix with '*')."""
    hit = F.lit(False)
    if ids:
        hit = hit | F.col("id").isin(*ids)
    if paths:
        hit = hit | has_any(F.col("location"), paths)
    for name in functions:
        col = F.col("function_name")
        hit = hit | (col.startswith(name[:-1]) if name.endswith("*") else col == name)
    return findings.filter(~F.coalesce(hit, F.lit(False)))


def suppress_by_table(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Anti-join with a (program, id) table of accepted findings; either column may be '*'."""
    s = suppressions.select(F.col("program").alias("_p"), F.col("id").alias("_i")).distinct()
    exact = s.filter("_p <> '*' and _i <> '*'")
    out = findings.join(exact, (F.col("program") == F.col("_p")) & (F.col("id") == F.col("_i")), "left_anti")
    any_id = s.filter("_p <> '*' and _i = '*'")
    out = out.join(any_id, F.col("program") == F.col("_p"), "left_anti")
    any_program = s.filter("_p = '*' and _i <> '*'")
    return out.join(any_program, F.col("id") == F.col("_i"), "left_anti")


def filter_categories(findings: DataFrame, allow=(), deny=()) -> DataFrame:
    """Deny wins; an empty allow list lets everything else through."""
    out = findings.filter(~F.col("category").isin(*deny)) if deny else findings
    return out.filter(F.col("category").isin(*allow)) if allow else out


# Ids that matter for a token's exit risk.
RUG_IDS = (
    "SOL-001", "SOL-003", "SOL-005", "SOL-007", "SOL-010", "SOL-011", "SOL-017", "SOL-021", "SOL-031", "SOL-041", "SOL-048",
    "SOL-053", "SOL-054", "SOL-055", "SOL-056", "SOL-057", "SOL-058", "SOL-064", "SOL-067", "SOL-068",
)


def select_ids(findings: DataFrame, ids=RUG_IDS) -> DataFrame:
    return findings.filter(F.col("id").isin(*ids))


def applicable(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows an analyzer wants to see; filter before its rule projection."""
    return df.filter(predicate)


def match_expected(findings: DataFrame, expected: list[tuple[str, str, int]] | DataFrame) -> DataFrame:
    """Expected bugs (program, pattern, min_severity) that some finding of the program covers."""
    text = F.lower(F.concat_ws("\u0001", "vuln_type", "description", "category"))
    f = findings.select(F.col("program").alias("_p"), F.col("severity").alias("_s"), text.alias("_t"))
    f = f.groupBy("_p", "_t").agg(F.max("_s").alias("_s"))
    cond = (
        (F.col("program") == F.col("_p"))
        & (F.col("_s") >= F.col("min_severity"))
        & F.contains(F.col("_t"), F.lower(F.col("vuln_pattern")))
    )
    return expected.join(f, cond, "left_semi")


def union_findings(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def limit_findings(df: DataFrame, n: int, order=("seq",)) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_findings(df: DataFrame, n: int = 10, floor: int = 3, seq: str = "seq") -> DataFrame:
    """Report of the n worst findings at or above a severity (TakeOrdered, no full sort)."""
    return df.filter(F.col("severity") >= floor).orderBy(F.desc("severity"), F.asc(seq)).limit(n)


def sort_findings(df: DataFrame, *, seq: str = "seq") -> DataFrame:
    return df.orderBy(F.desc("severity"), F.desc("confidence"), F.asc(seq))


def group_root_cause(findings: DataFrame, seq: str = "seq", scope: list[str] | None = None) -> DataFrame:
    """First finding per id with the number of places it was found at.

    The full list of other places is `root_cause_locations`: it can be as long as the table, so it
    stays a table.
    """
    keys = [*(scope or []), "id"]
    rest = [c for c in findings.columns if c not in keys]
    grouped = findings.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), seq).alias("_first"), F.count(F.lit(1)).alias("n_locations"))
    return grouped.select(*keys, "_first.*", "n_locations").select(*findings.columns, "n_locations")


def root_cause_locations(findings: DataFrame, seq: str = "seq", scope: list[str] | None = None) -> DataFrame:
    """Every further place of a root cause: `file` or `file:function`."""
    keys = [*(scope or []), "id"]
    first = findings.groupBy(*keys).agg(F.min(seq).alias("_first"))
    place = F.when(F.col("function_name") == "", basename(F.col("location"))).otherwise(
        F.concat_ws(":", basename(F.col("location")), F.col("function_name"))
    )
    return (
        findings.join(first, keys)
        .filter(F.col(seq) > F.col("_first"))
        .select(*keys, seq, place.alias("place"))
    )


def annotate_root_cause(findings: DataFrame, seq: str = "seq", scope: list[str] | None = None) -> DataFrame:
    """group_root_cause with the number of places written into the description; the places themselves are `root_cause_locations`,
    a table that can be as long as the findings."""
    note = F.concat(F.col("description"), F.lit(" [found in "), F.col("n_locations").cast("string"), F.lit(" locations]"))
    described = F.when(F.col("n_locations") > 1, note).otherwise(F.col("description"))
    return group_root_cause(findings, seq, scope).withColumn("description", described).drop("n_locations")


def diff_findings(before: DataFrame, after: DataFrame, keys=("id", "location", "function_name")) -> DataFrame:
    """Findings that are new, fixed or kept between two scans."""
    a = before.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = after.select(*keys).distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "fixed").otherwise("kept")
    return a.join(b, list(keys), "full").select(*keys, state.alias("state"))


def rank_scoreboard(df: DataFrame, score: str = "score", tie: str = "program") -> DataFrame:
    """Position 1..n by score, best first; ties by name."""
    return global_rank(df, [F.desc(score), F.asc(tie)])


# --- confidence -------------------------------------------------------------------------------

# Confidence of a rule by its registered severity, and of an unknown rule.
BASE_BY_SEVERITY = {5: 85, 4: 75, 3: 65, 2: 60}
BASE_OTHERWISE = 55
BASE_UNKNOWN = 80

# Text that shows the flaw in the finding's own code.
INLINE_EVIDENCE = {
    "SOL-063": [[".unwrap()"], ["remaining_accounts["]],
    "SOL-061": [["for ", "invoke"]],
    "SOL-064": [["authority", "set_"]],
    "SOL-002": [["+ "], ["* "], ["as u64"]],
    "SOL-045": [["+ "], ["* "], ["as u64"]],
    "SOL-094": [["+ "], ["* "], ["as u64"]],
}
CROSS_FILE_IDS = ("SOL-ALIAS-02", "SOL-ALIAS-05", "SOL-TAINT-02", "SOL-059")
MATH_IDS = ("SOL-050", "SOL-056")
MATH_WORDS = ("emission", "fee_rate", "reward", "fee_amount")
TYPED_AUTH_IDS = ("SOL-003", "SOL-004", "SOL-005", "SOL-010", "SOL-015", "SOL-024", "SOL-041")
DOMAIN_MARKERS = (
    "Context <", "Context<", "AccountInfo <", "AccountInfo<", "# [account", "#[account", "CpiContext", "invoke",
    "# [program]", "#[program]",
)


def assign_confidence(
    findings: DataFrame,
    context: DataFrame,
    base: DataFrame,
    by: str = "program",
    evidence=INLINE_EVIDENCE,
    cross_file=CROSS_FILE_IDS,
    math_ids=MATH_IDS,
    math_words=MATH_WORDS,
    typed_ids=TYPED_AUTH_IDS,
    markers=DOMAIN_MARKERS,
) -> DataFrame:
    """Confidence from the rule's base, the finding's code and its project's context.

    context: by, mitigated_ids ARRAY<STRING>, maturity DOUBLE, typed_ratio DOUBLE.
    base: id, base_confidence.
    """
    code, rule = F.col("vulnerable_code"), F.col("id")
    inline = F.lit(False)
    for rule_id, choices in evidence.items():
        seen = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [has(code, t) for t in c]) for c in choices])
        inline = inline | ((rule == rule_id) & seen)

    def points(cond, n):
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(float(n))).otherwise(F.lit(0.0))

    reliable = has_any(F.col("category"), ("Account Safety", "Authorization"))
    is_math = rule.isin(*math_ids)
    value = (
        F.coalesce(F.col("base_confidence"), F.lit(BASE_UNKNOWN)).cast("double")
        + points(inline, 15)
        + points(rule.isin(*cross_file), -12)
        + F.when(reliable, F.lit(5.0)).when(has(F.col("category"), "Heuristic"), F.lit(-10.0)).otherwise(F.lit(0.0))
        + points(is_math, -8)
        + points(is_math & has_any(code, math_words), 12)
        + points(F.array_contains(F.col("mitigated_ids"), rule), -30)
        - F.coalesce(F.col("maturity"), F.lit(0.0)) * 20
        + points((F.col("typed_ratio") > 0.7) & rule.isin(*typed_ids), -20)
        + points(~has_any(code, markers), -25)
        + points(F.col("severity") == 1, -15)
        + points(F.col("severity") == 2, -10)
        + points(F.col("severity") == 5, 5)
    )
    kept = [c for c in findings.columns if c != "confidence"]
    return (
        findings.select(*kept)
        .join(base.select("id", "base_confidence"), "id", "left")
        .join(context.select(by, "mitigated_ids", "maturity", "typed_ratio"), by, "left")
        .select(*kept, F.floor(clamp(value, 15.0, 95.0)).cast("int").alias("confidence"))
    )


def base_from_rules(rules: DataFrame) -> DataFrame:
    """(id, base_confidence) of a rule table; a later duplicate id wins."""
    by_severity = F.lit(BASE_OTHERWISE)
    for severity, value in BASE_BY_SEVERITY.items():
        by_severity = F.when(F.col("severity") == severity, F.lit(value)).otherwise(by_severity)
    full = rules.withColumn("_base", F.coalesce(F.col("base_confidence"), by_severity))
    return full.groupBy("id").agg(F.max_by("_base", "pos").alias("base_confidence"))
