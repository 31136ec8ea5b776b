"""Counters, votes, timings, coverage and anomaly aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import int_div
from auditlake.functions.text import fingerprint


def consensus(votes: DataFrame, models: DataFrame, threshold: float = 0.6, floor: float = 0.5) -> DataFrame:
    """Weighted verdict per finding. votes: finding_id, model, verdict, confidence; models: model, weight."""
    v = votes.join(models.select("model", "weight"), "model", "left")
    w = F.coalesce(F.col("weight"), F.lit(1.0))

    def weight_of(name):
        return F.sum(F.when(F.col("verdict") == name, w).otherwise(F.lit(0.0)))

    agg = v.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("n_votes"), weight_of("CONFIRMED").alias("_c"), weight_of("REJECTED").alias("_r"),
        F.sum(w).alias("_w"), F.sum(w * F.col("confidence")).alias("_wc"),
    )
    agreement = F.coalesce(F.try_divide(F.greatest("_c", "_r"), F.col("_w")), F.lit(0.0))
    confidence = F.coalesce(F.try_divide(F.col("_wc"), F.col("_w")), F.lit(0.0))
    final = (
        F.when((F.col("_c") > F.col("_r")) & (agreement >= threshold), "CONFIRMED")
        .when((F.col("_r") > F.col("_c")) & (agreement >= threshold), "REJECTED")
        .otherwise("UNCERTAIN")
    )
    return agg.select(
        "finding_id", "n_votes", final.alias("verdict"), agreement.alias("agreement"), confidence.alias("confidence"),
        ((final == "CONFIRMED") & (confidence >= floor)).alias("should_report"),
    )


def metrics(df: DataFrame, by: list[str], value: str = "value_ms") -> DataFrame:
    """Count, sum, whole-number average, least and greatest observation."""
    return df.groupBy(*by).agg(
        F.count(value).alias("count"), F.sum(value).alias("sum_ms"),
        int_div(F.sum(value), F.count(value)).alias("avg_ms"),
        F.min(value).alias("min_ms"), F.max(value).alias("max_ms"),
    )


def phase_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, slowest and most productive phase; on ties the later phase (by seq) wins."""
    slow = F.max_by("phase", F.struct("duration_ms", "seq"))
    best = F.max_by("phase", F.struct("findings", "seq"))
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("phases"), F.sum("duration_ms").alias("total_ms"), F.sum("findings").alias("total_findings"),
        slow.alias("slowest_phase"), best.alias("most_productive_phase"),
    )


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """In- and out-degree of every node, from one pass over the edge ends."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col(src).alias(node), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col(dst).alias(node), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )))
    per = ends.groupBy(node).agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.select(node).join(per, node, "left").fillna(0, ["out_degree", "in_degree"])


def graph_summary(nodes: DataFrame, edges: DataFrame, risk: str = "risk", risky: int = 50) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("programs"), F.sum((~F.col("verified")).cast("bigint")).alias("unverified"))
    e = edges.agg(
        F.count(F.lit(1)).alias("calls"), F.sum((F.col(risk) >= risky).cast("bigint")).alias("risky_calls"),
        F.max(F.col(risk).cast("bigint")).alias("max_risk"),
    )
    names = ("programs", "calls", "risky_calls", "unverified", "max_risk")
    return n.unionByName(e, allowMissingColumns=True).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def coverage(kb: DataFrame) -> DataFrame:
    """How many knowledge-base entries have a detector."""
    covered = F.size("detector_ids") > 0
    return kb.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(covered).alias("covered"),
        F.round(F.coalesce(F.try_divide(F.count_if(covered), F.count(F.lit(1))), F.lit(0.0)) * 100, 1).alias("coverage_pct"),
    )


def coverage_gaps(kb: DataFrame) -> DataFrame:
    return kb.filter(F.size("detector_ids") == 0)


def by_owner(registry: DataFrame, owner: str = "owner") -> DataFrame:
    """Registry size per owner; the entries themselves stay rows (`registry` filtered by owner)."""
    return registry.groupBy(owner).agg(
        F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


# Engines by id prefix; anything else is the pattern scanner.
ENGINES = {
    "SOL-TAINT": "Taint Lattice", "SOL-CFG": "CFG Dominators", "SOL-ABS": "Abstract Interp",
    "SOL-ALIAS": "Account Aliasing", "SOL-DEEP": "Deep AST Scanner",
}


def engine(rule: Column, engines=ENGINES, other: str = "Pattern Scanner") -> Column:
    out = F.lit(other)
    for prefix, name in engines.items():
        out = F.when(rule.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def engine_counts(findings: DataFrame, by: list[str] | None = None, engines=ENGINES, other="Pattern Scanner") -> DataFrame:
    return findings.groupBy(*(by or []), engine(F.col("id"), engines, other).alias("engine")).agg(
        F.count(F.lit(1)).alias("findings")
    )


def bench_summary(runs: DataFrame) -> DataFrame:
    """runs: name, run, duration_ms, files, findings (one row per timed iteration)."""
    mean = F.avg("duration_ms")
    files = F.max_by("files", "run")
    return runs.groupBy("name").agg(
        F.count(F.lit(1)).alias("iterations"), mean.alias("mean_ms"), files.alias("files"),
        F.max_by("findings", "run").alias("findings"), F.try_divide(files, mean / 1000.0).alias("files_per_sec"),
    )


def bench_compare(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """Speed-up and finding difference for each (baseline, comparison) pair of bench names."""
    a = summary.select(F.col("name").alias("baseline"), F.col("mean_ms").alias("_ma"), F.col("findings").alias("_fa"))
    b = summary.select(F.col("name").alias("comparison"), F.col("mean_ms").alias("_mb"), F.col("findings").alias("_fb"))
    speed = F.when(F.col("_mb") > 0, F.col("_ma") / F.col("_mb")).otherwise(F.lit(1.0))
    return pairs.join(a, "baseline").join(b, "comparison").select(
        "baseline", "comparison", speed.alias("speedup"), (F.col("_fb") - F.col("_fa")).alias("findings_diff")
    )


def coverage_union(hits: DataFrame, by: list[str], size: int) -> DataFrame:
    """OR of coverage bitmaps given as rows (run, pos, byte): share of non-zero places."""
    merged = hits.filter("byte <> 0").groupBy(*by, "pos").agg(F.bit_or("byte").alias("byte"))
    return merged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("covered"), F.bit_or("byte").alias("any_bits"),
        (F.count(F.lit(1)) / F.lit(size) * 100).alias("coverage_pct"),
    )


def bitmap_bytes(runs: DataFrame, bitmap: str = "coverage", keep=("run",)) -> DataFrame:
    """Rows (run, pos, byte) of binary coverage bitmaps."""
    hexes = F.regexp_extract_all(F.hex(bitmap), F.lit("(..)"), F.lit(1))
    return runs.select(*keep, F.posexplode(hexes).alias("pos", "_h")).select(
        *keep, "pos", F.conv("_h", 16, 10).cast("int").alias("byte")
    )


def new_coverage(hits: DataFrame, by: list[str], order: str = "run") -> DataFrame:
    """Runs that set a place no earlier run of the group had set."""
    first = hits.filter("byte <> 0").groupBy(*by, "pos").agg(F.min(order).alias(order))
    return first.groupBy(*by, order).agg(F.count(F.lit(1)).alias("new_places"))


def distinct_paths(runs: DataFrame, by: list[str], path: Column) -> DataFrame:
    return runs.groupBy(*by).agg(F.count_distinct(F.sha2(path, 256)).alias("paths"))


def crash_class(error: Column, code: Column) -> Column:
    text = F.coalesce(error, F.lit(""))
    any_of = lambda *tokens: text.rlike("|".join(tokens))
    return (
        F.when(any_of("overflow", "underflow"), "ArithmeticOverflow")
        .when(any_of("out of bounds", "index out of range"), "OutOfBounds")
        .when(any_of("panic"), "Panic").when(any_of("memory"), "MemoryExhaustion")
        .when(code.isNotNull(), "UnexpectedError").otherwise("Crash")
    )


def triage(crashes: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per distinct crash (message and code) with its class, first sighting and count."""
    fp = fingerprint(["error", "error_code"])
    return (
        crashes.withColumn("fingerprint", fp)
        .withColumn("crash_class", crash_class(F.col("error"), F.col("error_code")))
        .groupBy("fingerprint", "crash_class")
        .agg(F.count(F.lit(1)).alias("hits"), F.min(seq).alias("first_seen"))
    )


def scan_stats(df: DataFrame, by: list[str], instruction: str, account: str, file: str, lines: Column) -> DataFrame:
    """Distinct instructions, accounts and files, and lines scanned."""
    return df.groupBy(*by).agg(
        F.count_distinct(instruction).alias("instructions"), F.count_distinct(account).alias("accounts"),
        F.count_distinct(file).alias("files"), F.sum(lines).alias("lines"),
    )


# Baseline ratios of sound programs, and the deviation limits.
BASELINE = {
    "account_to_instruction_ratio": 2.5, "check_to_mutation_ratio": 1.2, "signer_check_frequency": 0.8,
    "cpi_validation_rate": 0.9, "arithmetic_safety_rate": 0.85,
}
ANOMALY = 0.75


def baseline_anomalies(stats: DataFrame, baseline: DataFrame, threshold: float = ANOMALY) -> DataFrame:
    """stats: <keys>, metric, observed; baseline: metric, expected."""
    deviation = F.abs(F.try_divide(F.col("observed") - F.col("expected"), F.col("expected")))
    severity = F.when(F.col("deviation") > 1.5, "High").when(F.col("deviation") > 1.0, "Medium").otherwise("Low")
    return (
        stats.join(baseline, "metric").withColumn("deviation", deviation)
        .filter(F.col("deviation") > threshold)
        .withColumn("severity", severity)
        .withColumn("confidence", F.least(F.lit(0.95), F.col("deviation") / 2))
    )


# Boost by severity and the weight of an unlisted method.
SEVERITY_BOOST = {"Critical": 1.2, "High": 1.1, "Medium": 1.0, "Low": 0.9, "Info": 0.8}
METHOD_OTHER = 0.5


def ensemble(findings: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """Confidence scaled by method weight and severity; weak findings dropped.
    weights: method, weight."""
    boost = F.lit(1.0)
    for name, value in SEVERITY_BOOST.items():
        boost = F.when(F.col("severity") == name, F.lit(value)).otherwise(boost)
    factor = F.lit(0.5) + F.coalesce(F.col("weight"), F.lit(METHOD_OTHER))
    return (
        findings.join(weights.select("method", "weight"), "method", "left")
        .withColumn("confidence", F.least(F.col("confidence") * factor * boost, F.lit(0.99)))
        .filter(F.col("confidence") >= threshold).drop("weight")
    )


def interval_profile(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Observed interval of two whole-number columns per group, of their + - x /, and what could go wrong.

    must_overflow: the whole result leaves u64; may_overflow: part of it does; div_by_zero: the divisor
    may be 0; may_negative: a - b may go below 0.
    """
    from auditlake.functions.numbers import U64_MAX, interval_add, interval_div, interval_mul, interval_sub

    wide = "decimal(38,0)"
    g = df.groupBy(*by).agg(
        F.struct(F.min(a).cast(wide).alias("lo"), F.max(a).cast(wide).alias("hi")).alias("a"),
        F.struct(F.min(b).cast(wide).alias("lo"), F.max(b).cast(wide).alias("hi")).alias("b"),
    )
    g = g.withColumns({
        "add": interval_add(F.col("a"), F.col("b")), "sub": interval_sub(F.col("a"), F.col("b")),
        "mul": interval_mul(F.col("a"), F.col("b")), "div": interval_div(F.col("a"), F.col("b")),
    })
    top = F.lit(str(U64_MAX)).cast(wide)
    must = lambda i: (i.lo > top) | (i.hi < 0)
    may = lambda i: ~must(i) & ((i.hi > top) | (i.lo < 0))
    return g.withColumns({
        "must_overflow": must(F.col("add")) | must(F.col("mul")) | must(F.col("sub")),
        "may_overflow": may(F.col("add")) | may(F.col("mul")),
        "div_by_zero": (F.col("b.lo") <= 0) & (F.col("b.hi") >= 0),
        "may_negative": F.col("sub.lo") < 0,
    })
