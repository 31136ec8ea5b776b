"""Finding dedupe, filters, grouping, confidence, caps, ranks and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.base import FINDINGS_SQL, findings, query, table
from auditlake.functions.numbers import grade
from auditlake.operators import findings as ops
from auditlake.operators import lookups, scores
from auditlake.operators.aggregates import engine_counts
from auditlake.plans.scoreboard import scoreboard
from auditlake.rules.controls import FRAMEWORKS

WITH = f"WITH {FINDINGS_SQL}"
BASIC = ["program", "id", "vuln_type", "location", "function_name", "line_number", "severity", "confidence", "origin"]
BASIC_SQL = ", ".join(BASIC)
PLACE = "CASE WHEN line_number > 0 THEN 'L' || CAST(line_number AS VARCHAR) ELSE 'F' || function_name END"
BEST = f"""best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY program, vuln_type, location, {PLACE}
  ORDER BY confidence DESC, seq) rn FROM findings) WHERE rn = 1)"""
LIMITS = "CASE severity WHEN 5 THEN 15 WHEN 4 THEN 20 WHEN 3 THEN 15 WHEN 2 THEN 10 WHEN 1 THEN 5 ELSE 15 END"
CAPPED = f"""capped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY program, severity
  ORDER BY confidence DESC, seq) rn FROM best) WHERE rn <= {LIMITS})"""
COUNTS = """sum(CASE WHEN severity = 5 THEN 1 ELSE 0 END)::BIGINT AS critical, sum(CASE WHEN severity = 4 THEN 1 ELSE 0 END)::BIGINT AS high,
  sum(CASE WHEN severity = 3 THEN 1 ELSE 0 END)::BIGINT AS medium, sum(CASE WHEN severity = 2 THEN 1 ELSE 0 END)::BIGINT AS low,
  sum(CASE WHEN severity <= 1 THEN 1 ELSE 0 END)::BIGINT AS info, count(*) AS total"""


def grade_sql(col):
    return (
        f"CASE WHEN {col} >= 95 THEN 'A+' WHEN {col} >= 90 THEN 'A' WHEN {col} >= 85 THEN 'A-' WHEN {col} >= 80 THEN 'B+' "
        f"WHEN {col} >= 75 THEN 'B' WHEN {col} >= 70 THEN 'B-' WHEN {col} >= 65 THEN 'C+' WHEN {col} >= 60 THEN 'C' "
        f"WHEN {col} >= 50 THEN 'D' ELSE 'F' END"
    )


PROGRAMS_SQL = """programs AS (SELECT 'P' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS program, s_acctbal > 0 AS source_verified,
  CASE WHEN s_nationkey < 6 THEN 'SingleWallet' WHEN s_nationkey < 12 THEN 'Unknown' WHEN s_nationkey < 18 THEN 'Multisig' ELSE 'Immutable' END AS authority_kind,
  CASE WHEN s_acctbal > 5000 THEN 3 ELSE 2 END AS threshold, 5 AS signers,
  CAST(floor(abs(s_acctbal)) AS INTEGER) % 101 AS guard_risk, s_nationkey FROM supplier)"""
PROTOCOL_SQL = """greatest(0, least(100, 100 - critical * 25 - high * 15 - medium * 5 - low * 2 - CASE WHEN source_verified THEN 0 ELSE 15 END
  - CASE WHEN authority_kind = 'SingleWallet' THEN 20 WHEN authority_kind = 'Unknown' THEN 25
         WHEN authority_kind = 'Multisig' AND signers > 0 AND threshold / signers < 0.5 THEN 10 ELSE 0 END - guard_risk // 4))"""


def programs(spark, sf):
    bal = F.col("s_acctbal")
    nat = F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("P"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("program"),
        (bal > 0).alias("source_verified"),
        F.when(nat < 6, "SingleWallet").when(nat < 12, "Unknown").when(nat < 18, "Multisig").otherwise("Immutable")
        .alias("authority_kind"),
        F.when(bal > 5000, 3).otherwise(2).alias("threshold"), F.lit(5).alias("signers"),
        (F.floor(F.abs(bal)).cast("int") % 101).alias("guard_risk"), nat,
    )


@query("plan_scoreboard", f"""{WITH}, {BEST}, {CAPPED}, {PROGRAMS_SQL},
counts AS (SELECT program, {COUNTS} FROM capped GROUP BY program),
scored AS (SELECT program, coalesce(critical, 0) critical, coalesce(high, 0) high, coalesce(medium, 0) medium, coalesce(low, 0) low,
  coalesce(info, 0) info, coalesce(total, 0) total, source_verified, authority_kind, threshold, signers, guard_risk
  FROM programs LEFT JOIN counts USING (program)),
final AS (SELECT *, CAST({PROTOCOL_SQL} AS INTEGER) AS score FROM scored)
SELECT row_number() OVER (ORDER BY score DESC, program) AS rank, program, score, {grade_sql('score')} AS grade,
  critical, high, medium, low, info, total FROM final""")
def plan_scoreboard(spark, sf):
    return scoreboard(findings(spark, sf), programs(spark, sf))


@query("dedupe_best", f"{WITH}, {BEST} SELECT {BASIC_SQL} FROM best")
def dedupe_best(spark, sf):
    return ops.dedupe_best(findings(spark, sf), scope=["program"]).select(*BASIC)


@query("dedupe_first", f"""{WITH} SELECT {BASIC_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY program, id, location ORDER BY seq) rn
 FROM findings) WHERE rn = 1""")
def dedupe_first(spark, sf):
    return ops.dedupe_first(findings(spark, sf), scope=["program"]).select(*BASIC)


@query("dedupe_fingerprint", f"""{WITH} SELECT sha256(program || ':' || vuln_type || ':' || location || ':' || function_name) AS fingerprint, origin, confidence
 FROM (SELECT *, row_number() OVER (PARTITION BY program, vuln_type, location, function_name ORDER BY seq) rn FROM findings) WHERE rn = 1""")
def dedupe_fingerprint(spark, sf):
    from auditlake.functions.text import fingerprint

    fp = fingerprint(["program", "vuln_type", "location", "function_name"])
    return ops.dedupe_fingerprint(findings(spark, sf), fp).select(fp.alias("fingerprint"), "origin", "confidence")


@query("cap_by_severity", f"{WITH}, {BEST}, {CAPPED} SELECT {BASIC_SQL} FROM capped")
def cap_by_severity(spark, sf):
    return ops.cap_by_severity(ops.dedupe_best(findings(spark, sf), scope=["program"])).select(*BASIC)


@query("rank_global", f"""{PROGRAMS_SQL and 'WITH ' + PROGRAMS_SQL} SELECT program, guard_risk,
 row_number() OVER (ORDER BY guard_risk DESC, program) AS rank FROM programs""")
def rank_global(spark, sf):
    return ops.rank_scoreboard(programs(spark, sf), "guard_risk").select("program", "guard_risk", "rank")


@query("drop_non_program", f"""{WITH} SELECT program, location, count(*) AS n FROM findings
 WHERE NOT regexp_matches(lower(location), 'test|bench|build\\.rs|examples|mock|fixture|migration|scripts|knowledge_base|vulnerability_db|vuln_knowledge|finding_validator|metrics|phase_timing|cli|tui')
 AND lower(location) <> 'main.rs' GROUP BY ALL""")
def drop_non_program(spark, sf):
    return ops.drop_non_program(findings(spark, sf)).groupBy("program", "location").agg(F.count(F.lit(1)).alias("n"))


@query("min_severity", f"{WITH} SELECT {BASIC_SQL} FROM findings WHERE severity >= 4")
def min_severity(spark, sf):
    return ops.min_severity(findings(spark, sf), 2, 4).select(*BASIC)


@query("min_confidence", f"{WITH} SELECT {BASIC_SQL} FROM findings WHERE confidence >= 55")
def min_confidence(spark, sf):
    return ops.min_confidence(findings(spark, sf)).select(*BASIC)


@query("suppress", f"""{WITH} SELECT {BASIC_SQL} FROM findings WHERE NOT (id IN ('SOL-003', 'SOL-017') OR contains(location, 'mod_3')
 OR function_name = 'fn_a1' OR starts_with(function_name, 'fn_r'))""")
def suppress(spark, sf):
    return ops.suppress(findings(spark, sf), ["SOL-003", "SOL-017"], ["mod_3"], ["fn_a1", "fn_r*"]).select(*BASIC)


@query("suppress_by_table", f"""{WITH}, s AS (SELECT 'P' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS program,
  CASE WHEN l_returnflag = 'A' THEN '*' ELSE 'SOL-' || lpad(CAST(1 + l_partkey % 90 AS VARCHAR), 3, '0') END AS id FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 7
  UNION ALL SELECT '*', 'SOL-009')
 SELECT {BASIC_SQL} FROM findings f WHERE NOT EXISTS (SELECT 1 FROM s WHERE (s.program = f.program OR s.program = '*') AND (s.id = f.id OR s.id = '*'))""")
def suppress_by_table(spark, sf):
    f = findings(spark, sf)
    accepted = f.filter("confidence = 95 and line_number = 6 and description like 'qty 50 %'").select(
        "program", F.when(F.col("vuln_type").startswith("TA"), "*").otherwise(F.col("id")).alias("id"))
    accepted = accepted.union(spark.createDataFrame([("*", "SOL-009")], "program string, id string"))
    return ops.suppress_by_table(f, accepted).select(*BASIC)


@query("filter_categories", f"{WITH} SELECT category, count(*) AS n FROM findings WHERE category = 'Authorization' GROUP BY category")
def filter_categories(spark, sf):
    f = ops.filter_categories(findings(spark, sf), ["Authorization", "Heuristic"], ["Heuristic"])
    return f.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("applicable", f"{WITH} SELECT program, count(*) AS n FROM findings WHERE contains(vulnerable_code, 'Context<') GROUP BY program")
def applicable(spark, sf):
    f = ops.applicable(findings(spark, sf), F.contains("vulnerable_code", F.lit("Context<")))
    return f.groupBy("program").agg(F.count(F.lit(1)).alias("n"))


RUG = ", ".join(f"'{i}'" for i in ops.RUG_IDS)


@query("select_ids", f"{WITH} SELECT id, severity, count(*) AS n FROM findings WHERE id IN ({RUG}) GROUP BY ALL")
def select_ids(spark, sf):
    return ops.select_ids(findings(spark, sf)).groupBy("id", "severity").agg(F.count(F.lit(1)).alias("n"))


EXPECTED_SQL = """expected AS (SELECT 'P' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS program, p AS vuln_pattern, CAST(m AS INTEGER) AS min_severity
  FROM supplier, (VALUES ('qty 50 FOR a', 5), ('Authorization', 4), ('tno', 3), ('reentrancy', 1)) v(p, m))"""
MATCHED = """EXISTS (SELECT 1 FROM findings f WHERE f.program = e.program AND f.severity >= e.min_severity
  AND contains(lower(f.vuln_type || chr(1) || f.description || chr(1) || f.category), lower(e.vuln_pattern)))"""


def expected_bugs(spark, sf):
    rows = F.array(*[F.struct(F.lit(p).alias("vuln_pattern"), F.lit(m).alias("min_severity")) for p, m in
                     (("qty 50 FOR a", 5), ("Authorization", 4), ("tno", 3), ("reentrancy", 1))])
    return programs(spark, sf).select("program", F.inline(rows))


@query("match_expected", f"{WITH}, {EXPECTED_SQL} SELECT * FROM expected e WHERE {MATCHED}")
def match_expected(spark, sf):
    return ops.match_expected(findings(spark, sf), expected_bugs(spark, sf))


@query("top_findings", f"{WITH} SELECT {BASIC_SQL} FROM findings WHERE severity >= 3 ORDER BY severity DESC, seq LIMIT 10")
def top_findings(spark, sf):
    return ops.top_findings(findings(spark, sf)).select(*BASIC)


@query("limit_findings", f"{WITH} SELECT {BASIC_SQL} FROM findings ORDER BY seq LIMIT 500")
def limit_findings(spark, sf):
    return ops.limit_findings(findings(spark, sf), 500).select(*BASIC)


@query("sort_findings", f"{WITH}, {BEST}, {CAPPED} SELECT {BASIC_SQL} FROM capped ORDER BY severity DESC, confidence DESC, seq")
def sort_findings(spark, sf):
    return ops.sort_findings(ops.cap_by_severity(ops.dedupe_best(findings(spark, sf), scope=["program"]))).select(*BASIC)


@query("union_findings", f"""{WITH} SELECT program, id, count(*) AS n, count(function_name) AS with_function FROM (
 SELECT program, id, function_name FROM findings UNION ALL SELECT program, 'X-' || id, NULL FROM findings WHERE severity = 5) GROUP BY ALL""")
def union_findings(spark, sf):
    f = findings(spark, sf)
    other = f.filter("severity = 5").select("program", F.concat(F.lit("X-"), "id").alias("id"))
    return ops.union_findings(f, other).groupBy("program", "id").agg(
        F.count(F.lit(1)).alias("n"), F.count("function_name").alias("with_function"))


@query("diff_findings", f"""{WITH}, a AS (SELECT DISTINCT program, id, location FROM findings WHERE confidence >= 40),
 b AS (SELECT DISTINCT program, id, location FROM findings WHERE severity >= 3)
 SELECT program, id, location, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'fixed' ELSE 'kept' END AS state
 FROM (SELECT *, 1 k FROM a) a FULL JOIN (SELECT *, 1 k FROM b) b USING (program, id, location)""")
def diff_findings(spark, sf):
    f = findings(spark, sf)
    return ops.diff_findings(f.filter("confidence >= 40"), f.filter("severity >= 3"), ("program", "id", "location"))


@query("group_root_cause", f"""{WITH} SELECT program, id, origin, location, n_locations FROM (SELECT *, row_number() OVER w AS rn,
 count(*) OVER (PARTITION BY program, id) AS n_locations FROM findings WINDOW w AS (PARTITION BY program, id ORDER BY seq)) WHERE rn = 1""")
def group_root_cause(spark, sf):
    return ops.group_root_cause(findings(spark, sf), scope=["program"]).select("program", "id", "origin", "location", "n_locations")


@query("root_cause_locations", f"""{WITH}, r AS (SELECT *, min(seq) OVER (PARTITION BY program, id) AS first FROM findings)
 SELECT program, id, origin, CASE WHEN function_name = '' THEN split_part(location, '/', 2) ELSE split_part(location, '/', 2) || ':' || function_name END AS place
 FROM r WHERE seq > first""")
def root_cause_locations(spark, sf):
    out = ops.root_cause_locations(findings(spark, sf), scope=["program"])
    return out.select("program", "id", F.col("seq.a").alias("origin"), "place")


@query("annotate_root_cause", f"""{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY program, id ORDER BY seq) rn, count(*) OVER (PARTITION BY program, id) n FROM findings)
 SELECT program, id, CASE WHEN n = 1 THEN description ELSE description || ' [found in ' || n || ' locations]' END AS description FROM r WHERE rn = 1""")
def annotate_root_cause(spark, sf):
    return ops.annotate_root_cause(findings(spark, sf), scope=["program"]).select("program", "id", "description")


CTX_SQL = """ctx AS (SELECT 'P' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS program, CASE WHEN s_nationkey < 10 THEN ['SOL-002', 'SOL-045'] ELSE ['SOL-003'] END AS mitigated_ids,
  (s_nationkey + 1) / 26.0 AS maturity, s_nationkey / 25.0 AS typed_ratio FROM supplier)"""


def contexts(spark, sf):
    n = F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("P"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("program"),
        F.when(n < 10, F.array(F.lit("SOL-002"), F.lit("SOL-045"))).otherwise(F.array(F.lit("SOL-003"))).alias("mitigated_ids"),
        ((n + 1) / 26.0).alias("maturity"), (n / 25.0).alias("typed_ratio"))


@query("assign_confidence", f"""{WITH}, {CTX_SQL}, b AS (SELECT DISTINCT id, severity FROM findings),
base AS (SELECT 'SOL-' || lpad(CAST(1 + p_partkey % 90 AS VARCHAR), 3, '0') AS id, max(CASE WHEN p_partkey % 90 < 80 THEN CAST(50 + p_partkey % 90 % 40 AS DOUBLE) END) AS base FROM part GROUP BY 1),
j AS (SELECT f.*, coalesce(base, 80.0) AS base, mitigated_ids, CAST(maturity AS DOUBLE) AS maturity, typed_ratio FROM findings f LEFT JOIN base USING (id) LEFT JOIN ctx USING (program)),
v AS (SELECT *, base
  + CASE WHEN (id = 'SOL-063' AND (contains(vulnerable_code, '.unwrap()') OR contains(vulnerable_code, 'remaining_accounts[')))
      OR (id = 'SOL-061' AND contains(vulnerable_code, 'for ') AND contains(vulnerable_code, 'invoke'))
      OR (id = 'SOL-064' AND contains(vulnerable_code, 'authority') AND contains(vulnerable_code, 'set_'))
      OR (id IN ('SOL-002', 'SOL-045', 'SOL-094') AND (contains(vulnerable_code, '+ ') OR contains(vulnerable_code, '* ') OR contains(vulnerable_code, 'as u64'))) THEN 15 ELSE 0 END
  - CASE WHEN id IN ('SOL-ALIAS-02', 'SOL-ALIAS-05', 'SOL-TAINT-02', 'SOL-059') THEN 12 ELSE 0 END
  + CASE WHEN category = 'Authorization' THEN 5 ELSE -10 END
  - CASE WHEN id IN ('SOL-050', 'SOL-056') THEN 8 ELSE 0 END
  + CASE WHEN id IN ('SOL-050', 'SOL-056') AND regexp_matches(vulnerable_code, 'emission|fee_rate|reward|fee_amount') THEN 12 ELSE 0 END
  - CASE WHEN list_contains(mitigated_ids, id) THEN 30 ELSE 0 END - maturity * 20
  - CASE WHEN typed_ratio > 0.7 AND id IN ('SOL-003', 'SOL-004', 'SOL-005', 'SOL-010', 'SOL-015', 'SOL-024', 'SOL-041') THEN 20 ELSE 0 END
  - CASE WHEN contains(vulnerable_code, 'Context<') THEN 0 ELSE 25 END
  + CASE severity WHEN 1 THEN -15 WHEN 2 THEN -10 WHEN 5 THEN 5 ELSE 0 END AS c FROM j)
SELECT program, id, severity, origin, CAST(floor(least(95.0, greatest(15.0, c))) AS INTEGER) AS confidence FROM v""")
def assign_confidence(spark, sf):
    base = table(spark, sf, "part").select(
        F.concat(F.lit("SOL-"), F.lpad((F.col("p_partkey") % 90 + 1).cast("string"), 3, "0")).alias("id"),
        F.when(F.col("p_partkey") % 90 < 80, F.col("p_partkey") % 90 % 40 + 50).alias("v")).groupBy("id").agg(F.max("v").alias("base_confidence"))
    return ops.assign_confidence(findings(spark, sf), contexts(spark, sf), base).select(
        "program", "id", "severity", "origin", "confidence")


@query("severity_counts", f"{WITH} SELECT program, {COUNTS} FROM findings GROUP BY program")
def severity_counts(spark, sf):
    return scores.severity_counts(findings(spark, sf), ["program"])


@query("severity_counts_label", f"""{WITH} SELECT program, count(*) FILTER (severity_label = 'CRITICAL') AS critical, count(*) FILTER (severity_label = 'HIGH') AS high,
 count(*) FILTER (severity_label = 'MEDIUM') AS medium, count(*) FILTER (severity_label = 'LOW') AS low, count(*) FILTER (severity_label = 'INFO') AS info, count(*) AS total
 FROM findings GROUP BY program""")
def severity_counts_label(spark, sf):
    return scores.severity_counts(findings(spark, sf), ["program"], "label")


@query("engine_counts", f"""{WITH}, e AS (SELECT CASE WHEN line_number = 0 THEN 'SOL-TAINT-01' WHEN line_number = 1 THEN 'SOL-CFG-02' WHEN line_number = 2 THEN 'SOL-ABS-01'
 WHEN line_number = 3 THEN 'SOL-ALIAS-04' WHEN line_number = 4 THEN 'SOL-DEEP-01' ELSE id END AS id FROM findings)
 SELECT CASE WHEN starts_with(id, 'SOL-TAINT') THEN 'Taint Lattice' WHEN starts_with(id, 'SOL-CFG') THEN 'CFG Dominators' WHEN starts_with(id, 'SOL-ABS') THEN 'Abstract Interp'
 WHEN starts_with(id, 'SOL-ALIAS') THEN 'Account Aliasing' WHEN starts_with(id, 'SOL-DEEP') THEN 'Deep AST Scanner' ELSE 'Pattern Scanner' END AS engine, count(*) AS findings FROM e GROUP BY 1""")
def engine_counts_query(spark, sf):
    n = F.col("line_number")
    rule = (F.when(n == 0, "SOL-TAINT-01").when(n == 1, "SOL-CFG-02").when(n == 2, "SOL-ABS-01").when(n == 3, "SOL-ALIAS-04")
            .when(n == 4, "SOL-DEEP-01").otherwise(F.col("id")))
    return engine_counts(findings(spark, sf).withColumn("id", rule))


CONTROLS_VALUES = ", ".join(
    f"('{f}', '{c}', '{n}', [{', '.join(repr(i) for i in ids)}])" for rows in FRAMEWORKS.values() for f, c, n, ids in rows)
CONTROLS_SQL = f"controls AS (SELECT * FROM (VALUES {CONTROLS_VALUES}) v(framework, control_id, name, ids))"
ALL_CONTROLS = [row for rows in FRAMEWORKS.values() for row in rows]
STATUS_SQL = """status AS (SELECT p.program, c.framework, c.control_id, c.name, CASE WHEN n_findings > 0 THEN 'Fail' ELSE 'Pass' END AS status,
 coalesce(n_findings, 0) AS n_findings, coalesce(n_ids, 0) AS n_ids
 FROM (SELECT DISTINCT program FROM findings) p CROSS JOIN controls c LEFT JOIN
 (SELECT program, framework, control_id, count(*) AS n_findings, count(DISTINCT id) AS n_ids FROM findings JOIN controls ON list_contains(ids, id) WHERE severity >= 5 GROUP BY ALL) x
 ON x.program = p.program AND x.framework = c.framework AND x.control_id = c.control_id)"""


def _status(spark, sf):
    f = findings(spark, sf)
    scoped = f.withColumn("id", F.when(F.col("severity") >= 5, F.col("id")))
    return lookups.control_status(scoped, ALL_CONTROLS, ["program"])


@query("control_status", f"{WITH}, {CONTROLS_SQL}, {STATUS_SQL} SELECT * FROM status")
def control_status(spark, sf):
    return _status(spark, sf)


@query("compliance_score", f"""{WITH}, {CONTROLS_SQL}, {STATUS_SQL} SELECT program, framework, count(*) FILTER (status = 'Pass') AS passed,
 count(*) FILTER (status = 'Fail') AS failed, CAST(floor(count(*) FILTER (status = 'Pass') / greatest(count(*), 1) * 100) AS INTEGER) AS compliance_score FROM status GROUP BY ALL""")
def compliance_score(spark, sf):
    return lookups.compliance_score(_status(spark, sf), ["program", "framework"])


@query("control_evidence", f"""{WITH}, {CONTROLS_SQL} SELECT f.program, framework, control_id, origin, '[' || id || '] ' || vuln_type || ': ' || description AS evidence,
 CASE severity WHEN 5 THEN 'Immediate' WHEN 4 THEN '7 days' WHEN 3 THEN '30 days' ELSE '90 days' END AS deadline FROM findings f JOIN controls ON list_contains(ids, id)""")
def control_evidence(spark, sf):
    out = lookups.control_evidence(findings(spark, sf), ALL_CONTROLS)
    return out.select("program", "framework", "control_id", "origin", "evidence",
                      lookups.deadline(F.col("severity")).alias("deadline"))


KB_SQL = """kb AS (SELECT p_partkey AS pos, ['SOL-' || lpad(CAST(1 + p_partkey % 45 AS VARCHAR), 3, '0'), 'SOL-' || lpad(CAST(1 + p_size AS VARCHAR), 3, '0')] AS detector_ids,
 'KB ' || p_name AS description, p_brand AS fix FROM part)"""


def knowledge_base(spark, sf):
    def rule(n):
        return F.concat(F.lit("SOL-"), F.lpad(n.cast("string"), 3, "0"))

    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("pos"), F.array(rule(F.col("p_partkey") % 45 + 1), rule(F.col("p_size") + 1)).alias("detector_ids"),
        F.concat(F.lit("KB "), "p_name").alias("description"), F.col("p_brand").alias("fix"))


@query("enrich", f"""{WITH}, {KB_SQL}, x AS (SELECT id, arg_min(description, pos) AS description, arg_min(fix, pos) AS fix FROM
 (SELECT unnest(detector_ids) AS id, * EXCLUDE (detector_ids) FROM kb) GROUP BY id)
 SELECT f.program, f.id, f.origin, coalesce(nullif(f.function_name, ''), x.description, f.function_name) AS function_name, coalesce(nullif(f.description, ''), x.description, f.description) AS description
 FROM findings f LEFT JOIN x USING (id)""")
def enrich(spark, sf):
    f = lookups.enrich(findings(spark, sf), knowledge_base(spark, sf),
                       {"function_name": "description", "description": "description"})
    return f.select("program", "id", "origin", "function_name", "description")


@query("suggest_fixes", f"""{WITH}, p AS (SELECT * FROM (VALUES ('SOL-001', 'signer'), ('SOL-002', 'checked'), ('SOL-005', 'program_id')) v(id, pattern)),
 x AS (SELECT * FROM (VALUES ('signer', 'use Signer'), ('checked', 'use checked math')) v(pattern, fix))
 SELECT id, pattern, fix, count(*) AS n FROM findings LEFT JOIN (SELECT * FROM p LEFT JOIN x USING (pattern)) USING (id) GROUP BY ALL""")
def suggest_fixes(spark, sf):
    patterns = spark.createDataFrame([("SOL-001", "signer"), ("SOL-002", "checked"), ("SOL-005", "program_id")], "id string, pattern string")
    fixes = spark.createDataFrame([("signer", "use Signer"), ("checked", "use checked math")], "pattern string, fix string")
    return lookups.suggest_fixes(findings(spark, sf), patterns, fixes).groupBy("id", "pattern", "fix").agg(F.count(F.lit(1)).alias("n"))


@query("insights", f"""{WITH}, {KB_SQL}, t AS (SELECT 'SOL-' || lpad(CAST(1 + p_partkey % 45 AS VARCHAR), 3, '0') AS id, min(p_name) AS advice FROM part GROUP BY 1)
 SELECT program, advice, count(*) AS n FROM findings LEFT JOIN t USING (id) GROUP BY ALL""")
def insights(spark, sf):
    advice = table(spark, sf, "part").groupBy(
        F.concat(F.lit("SOL-"), F.lpad((F.col("p_partkey") % 45 + 1).cast("string"), 3, "0")).alias("id")).agg(F.min("p_name").alias("advice"))
    return lookups.insights(findings(spark, sf), advice).groupBy("program", "advice").agg(F.count(F.lit(1)).alias("n"))


@query("to_findings", """SELECT 'E' || event_id AS id, event_type AS vuln_type, 'user_' || user_id AS location,
 CAST(CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 ELSE 1 END AS INTEGER) AS severity FROM events""")
def to_findings(spark, sf):
    return lookups.to_findings(
        table(spark, sf, "events"),
        {"id": F.concat(F.lit("E"), F.col("event_id").cast("string")), "vuln_type": F.col("event_type"),
         "location": F.concat(F.lit("user_"), F.col("user_id").cast("string"))},
        {"Error": 5, "Purchase": 4, "Signup": 3}, "event_type")


@query("grades", f"""SELECT p_partkey, {grade_sql('(p_size * 2)')} AS grade FROM part""")
def grades(spark, sf):
    return table(spark, sf, "part").select("p_partkey", grade(F.col("p_size") * 2).alias("grade"))


@query("detectors", f"""{WITH} SELECT detector, id, severity, count(*) AS n FROM (SELECT 'strong' AS detector, id, severity FROM findings WHERE confidence >= 80
 UNION ALL SELECT 'auth', id, severity FROM findings WHERE category = 'Authorization') WHERE severity >= 3 GROUP BY ALL""")
def detectors(spark, sf):
    """Two plug-ins and one that fails; the failure becomes a row of the error table."""
    from auditlake.plans.detectors import Detector, DetectorSet

    registry = DetectorSet(floor=3)
    registry.register(Detector("strong", "1", lambda df: df.filter("confidence >= 80")))
    registry.register(Detector("auth", "1", lambda df: df, F.col("category") == "Authorization"))
    registry.register(Detector("broken", "1", lambda df: df.select("no_such_column")))
    found, errors = registry.run(findings(spark, sf))
    assert errors.count() == 1
    return found.groupBy("detector", "id", "severity").agg(F.count(F.lit(1)).alias("n"))
