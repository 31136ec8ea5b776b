"""Scores, votes, evaluation, metrics, coverage and lookups by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.base import FINDINGS_SQL, findings, query, table
from auditlake.catalog.finding_queries import EXPECTED_SQL, MATCHED, PROGRAMS_SQL, PROTOCOL_SQL, expected_bugs, programs
from auditlake.operators import aggregates, evaluate, fuzzy, lookups, scores

WITH = f"WITH {FINDINGS_SQL}"
# supplier rows carry the counts of a scored program
COUNTED_SQL = """counted AS (SELECT s_suppkey, s_nationkey % 4 AS critical, s_suppkey % 5 AS high, s_nationkey % 7 AS medium, s_suppkey % 11 AS low, s_suppkey % 3 AS info,
 s_suppkey % 13 AS rest, s_acctbal > 2000 AS source_verified, s_nationkey < 12 AS authority_revoked, s_suppkey % 2 = 0 AS is_upgradeable FROM supplier)"""


def counted(spark, sf):
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        "s_suppkey", (n % 4).alias("critical"), (s % 5).alias("high"), (n % 7).alias("medium"), (s % 11).alias("low"),
        (s % 3).alias("info"), (s % 13).alias("rest"), (F.col("s_acctbal") > 2000).alias("source_verified"),
        (n < 12).alias("authority_revoked"), (s % 2 == 0).alias("is_upgradeable"))


@query("protocol_score", f"""WITH {PROGRAMS_SQL}, c AS (SELECT *, s_nationkey % 3 AS critical, s_nationkey % 2 AS high, s_nationkey % 4 AS medium, s_nationkey % 5 AS low FROM programs)
 SELECT program, CAST({PROTOCOL_SQL} AS INTEGER) AS score FROM c""")
def protocol_score(spark, sf):
    n = F.col("s_nationkey")
    df = programs(spark, sf).withColumns({"critical": n % 3, "high": n % 2, "medium": n % 4, "low": n % 5})
    return df.select("program", scores.protocol_score().alias("score"))


@query("scan_risk", f"""WITH {COUNTED_SQL}, r AS (SELECT s_suppkey, CAST(least(100, critical * 15 + high * 8 + medium * 4 + low * 2 + info) AS INTEGER) AS risk FROM counted)
 SELECT s_suppkey, risk, CASE WHEN risk <= 20 THEN 'Low Risk' WHEN risk <= 40 THEN 'Moderate Risk' WHEN risk <= 60 THEN 'Elevated Risk' WHEN risk <= 80 THEN 'High Risk' ELSE 'Critical Risk' END AS level FROM r""")
def scan_risk(spark, sf):
    df = counted(spark, sf).withColumn("risk", scores.scan_risk())
    bands = ((20, "Low Risk"), (40, "Moderate Risk"), (60, "Elevated Risk"), (80, "High Risk"))
    return df.select("s_suppkey", "risk", scores.risk_level(F.col("risk"), bands, "Critical Risk").alias("level"))


@query("verify_score", f"""WITH {COUNTED_SQL} SELECT s_suppkey, CAST(greatest(0, least(100, 100 - critical * 25 - high * 15 - medium * 5 - rest)) AS INTEGER) AS score,
 CASE WHEN source_verified AND critical = 0 AND high = 0 AND (authority_revoked OR NOT is_upgradeable) THEN 'Gold'
      WHEN source_verified AND critical = 0 AND high <= 2 THEN 'Silver' WHEN critical = 0 THEN 'Bronze' ELSE 'Unverified' END AS tier FROM counted""")
def verify_score(spark, sf):
    return counted(spark, sf).select("s_suppkey", scores.verify_score().alias("score"), scores.verify_tier().alias("tier"))


@query("guard_risk", """SELECT l_suppkey, l_shipdate, CAST(least(100, sum(CASE l_returnflag WHEN 'A' THEN 25 WHEN 'R' THEN 15 WHEN 'N' THEN 2 ELSE 0 END
 + CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 25 ELSE 0 END)) AS INTEGER) AS guard_risk FROM lineitem GROUP BY l_suppkey, l_shipdate""")
def guard_risk(spark, sf):
    flag = F.col("l_returnflag")
    df = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", F.when(flag == "A", "Critical").when(flag == "R", "High").otherwise("Low").alias("severity"),
        F.when(F.col("l_linestatus") == "O", "KnownMalicious").otherwise("Typosquat").alias("category"))
    return scores.guard_risk(df, ["l_suppkey", "l_shipdate"])


@query("health_score", f"""WITH {COUNTED_SQL} SELECT s_suppkey, CAST(floor(greatest(0.0, least(100.0, 100.0::DOUBLE - least(critical * 15.0::DOUBLE / (1 + critical * 0.2::DOUBLE), 40) - least(high * 10.0::DOUBLE / (1 + high * 0.3::DOUBLE), 25)
 - least(medium * 5.0::DOUBLE / (1 + medium * 0.4::DOUBLE), 15) - least(low * 2.0::DOUBLE / (1 + low * 0.5::DOUBLE), 8)))) AS INTEGER) AS health FROM counted""")
def health_score(spark, sf):
    return counted(spark, sf).select("s_suppkey", scores.health_score().alias("health"))


@query("unsafe_score", """SELECT p_partkey, CAST(floor(greatest(0.0, least(100.0, 100.0::DOUBLE - (p_size % 5)::DOUBLE / (p_size * 20) * 1000 - (p_size % 3)::DOUBLE / (p_size * 20) * 800
 - (p_size % 4)::DOUBLE / (p_size * 20) * 600 - (p_size % 7)::DOUBLE / (p_size * 20) * 500 - (p_size % 2)::DOUBLE / (p_size * 20) * 700 - 0 - (p_size % 6)::DOUBLE / (p_size * 20) * 400))) AS INTEGER) AS score FROM part""")
def unsafe_score(spark, sf):
    s = F.col("p_size")
    df = table(spark, sf, "part").withColumns({
        "total_lines": s * 20, "unsafe_blocks": s % 5, "unsafe_functions": s % 3, "ffi_calls": s % 4, "raw_pointers": s % 7,
        "transmute_calls": s % 2, "asm_blocks": F.lit(0), "unsafe_traits": s % 6})
    return df.select("p_partkey", scores.unsafe_score().alias("score"))


@query("anchor_score", f"""WITH {COUNTED_SQL} SELECT s_suppkey, CAST(floor(greatest(0.0, least(100.0, 100.0 - (critical % 2) * 15.0 - (high % 2) * 12.0 - (medium % 2) * 10.0 - (low % 2) * 18.0 - info * 8.0
 - (critical // 3) * 20.0 - (high // 4) * 10.0 + info * 5.0 + high * 2.0 - critical * 5.0 - high * 3.0 - medium * 1.0 - low * 0.5))) AS INTEGER) AS score FROM counted""")
def anchor_score(spark, sf):
    c, h, m, w, i = (F.col(x) for x in ("critical", "high", "medium", "low", "info"))
    df = counted(spark, sf).withColumns({
        "missing_signer_checks": c % 2, "missing_owner_checks": h % 2, "missing_pda_validation": m % 2, "missing_cpi_guards": w % 2,
        "weak_constraints": i, "reinit_vulnerabilities": F.floor(c / 3), "missing_close_guards": F.floor(h / 4),
        "token_hook_implementations": i, "custom_constraint_count": h})
    return df.select("s_suppkey", scores.anchor_score().alias("score"))


TOKEN_SQL = """tokens AS (SELECT s_suppkey AS mint, CASE WHEN s_nationkey % 3 = 0 THEN 'a' END AS mint_authority, CASE WHEN s_suppkey % 4 = 0 THEN 'f' END AS freeze_authority,
 s_suppkey % 2 = 0 AS is_upgradeable, s_acctbal / 150 AS top_holder_concentration, s_nationkey % 2 = 0 AS liquidity_locked,
 CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey * 100000 END AS liquidity_lock_duration FROM supplier)"""


def tokens(spark, sf):
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        s.alias("mint"), F.when(n % 3 == 0, "a").alias("mint_authority"), F.when(s % 4 == 0, "f").alias("freeze_authority"),
        (s % 2 == 0).alias("is_upgradeable"), (F.col("s_acctbal") / 150).alias("top_holder_concentration"),
        (n % 2 == 0).alias("liquidity_locked"), F.when(n % 2 == 0, s * 100000).alias("liquidity_lock_duration"))


@query("token_risk", f"""WITH {TOKEN_SQL}, fl AS (SELECT *, mint_authority IS NOT NULL AS can_mint, freeze_authority IS NOT NULL AS can_freeze, top_holder_concentration > 50 AS concentrated,
  NOT liquidity_locked AS nolock, coalesce(liquidity_lock_duration < 2592000, FALSE) AS shortlock FROM tokens),
 c AS (SELECT l_suppkey AS mint, count(*) FILTER (l_quantity = 1 AND l_discount = 0 AND l_linenumber >= 4) AS hi, count(*) FILTER (l_quantity = 1 AND l_discount = 0 AND l_linenumber = 3) AS med FROM lineitem GROUP BY 1),
 s AS (SELECT fl.*, CAST(floor(least(100.0, (CASE WHEN can_mint THEN 20 ELSE 0 END) + (CASE WHEN can_freeze THEN 10 ELSE 0 END) + (CASE WHEN is_upgradeable THEN 10 ELSE 0 END)
  + (CASE WHEN concentrated THEN 10 ELSE 0 END) + (CASE WHEN nolock THEN 7 ELSE 0 END) + (CASE WHEN shortlock THEN 3 ELSE 0 END) + least(coalesce(hi, 0) * 8.0, 30) + least(coalesce(med, 0) * 3.0, 10))) AS INTEGER) AS risk_score FROM fl LEFT JOIN c USING (mint)),
 p AS (SELECT *, CASE WHEN can_mint AND concentrated THEN least(risk_score / 100.0::DOUBLE * 1.5::DOUBLE, 0.99::DOUBLE) ELSE risk_score / 100.0::DOUBLE END AS p1 FROM s)
 SELECT mint, risk_score, round(CASE WHEN is_upgradeable AND nolock THEN least(p1 * 1.3::DOUBLE, 0.99::DOUBLE) ELSE p1 END, 2) AS rug_probability,
 CASE WHEN risk_score <= 10 THEN 'A+' WHEN risk_score <= 20 THEN 'A' WHEN risk_score <= 30 THEN 'B' WHEN risk_score <= 40 THEN 'C' WHEN risk_score <= 50 THEN 'D' WHEN risk_score <= 70 THEN 'E' ELSE 'F' END AS grade FROM p""")
def token_risk(spark, sf):
    severity = F.when(F.expr("l_quantity = 1 and l_discount = 0"), F.least(F.lit(5), F.col("l_linenumber"))).otherwise(1)
    f = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("mint"), severity.alias("severity"))
    return scores.token_risk(tokens(spark, sf), f).select("mint", "risk_score", "rug_probability", "grade")


@query("holder_concentration", """WITH h AS (SELECT l_suppkey AS mint, l_partkey AS holder, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS balance FROM lineitem GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY balance DESC, holder) rn, sum(balance) OVER (PARTITION BY mint) AS total FROM h)
 SELECT mint, round(sum(balance)::DOUBLE / max(total)::DOUBLE * 100, 4) AS top_holder_concentration FROM r WHERE rn <= 10 GROUP BY mint""")
def holder_concentration(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("mint"), F.col("l_partkey").alias("holder"),
                                            F.col("l_extendedprice").cast("decimal(18,2)").alias("balance"))
    per = b.groupBy("mint", "holder").agg(F.sum("balance").cast("double").alias("balance"))
    out = scores.holder_concentration(per, 10)
    return out.select("mint", F.round("top_holder_concentration", 4).alias("top_holder_concentration"))


WARN_SQL = """warn AS (SELECT user_id % 997 AS unit, CASE event_type WHEN 'error' THEN 'RuntimeDifference' WHEN 'click' THEN 'ClockResolutionAssumption' WHEN 'view' THEN 'SyscallMeteringDiff'
 WHEN 'purchase' THEN 'ConcurrentAccountAccess' ELSE 'TransactionOrderingDependency' END AS kind, CASE WHEN value > 50 THEN 'BREAKING' WHEN value > 20 THEN 'RISKY' WHEN value > 5 THEN 'INFO' ELSE 'OTHER' END AS severity,
 date_trunc('day', ts) AS day FROM events)"""


@query("compat_score", f"""WITH {WARN_SQL} SELECT unit, day, CAST(greatest(0, least(100, 100 + sum(CASE kind WHEN 'RuntimeDifference' THEN CASE severity WHEN 'BREAKING' THEN -15 WHEN 'RISKY' THEN -8 WHEN 'INFO' THEN -2 ELSE -5 END
 WHEN 'ClockResolutionAssumption' THEN -5 WHEN 'SyscallMeteringDiff' THEN -3 WHEN 'ConcurrentAccountAccess' THEN -8 ELSE -12 END))) AS INTEGER) AS compat_score FROM warn GROUP BY ALL""")
def compat_score(spark, sf):
    t, v = F.col("event_type"), F.col("value")
    w = table(spark, sf, "events").select(
        (F.col("user_id") % 997).alias("unit"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"),
        F.when(t == "error", "RuntimeDifference").when(t == "click", "ClockResolutionAssumption").when(t == "view", "SyscallMeteringDiff")
        .when(t == "purchase", "ConcurrentAccountAccess").otherwise("TransactionOrderingDependency").alias("kind"),
        F.when(v > 50, "BREAKING").when(v > 20, "RISKY").when(v > 5, "INFO").otherwise("OTHER").alias("severity"))
    return scores.compat_score(w, ["unit", "day"])


def _occ(token):
    return f"((length(text) - length(replace(text, '{token}', ''))) // {len(token)})"


@query("compute_budget", f"""WITH u AS (SELECT doc_id, contains(text, 'the') OR contains(text, 'der ') AS sets_limit,
 list_filter(list_transform(regexp_extract_all(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, 'token|mail')), ' '), '[0-9]+'), lambda n: try_cast(n AS BIGINT)), lambda n: n > 1000 AND n <= 4294967295) AS limits,
 5000 + {_occ('tion')} * 1000 + {_occ('ment')} * 100 + {_occ('ing ')} * 90 AS cu_usage, {_occ('and')} * 2 + {_occ('le ')} * 5 AS cu_delta FROM documents),
 v AS (SELECT doc_id, sets_limit, CASE WHEN sets_limit THEN limits[1] END AS cu_limit, cu_usage, cu_delta FROM u),
 m AS (SELECT *, (coalesce(cu_limit, 200000)::DOUBLE - (cu_usage + cu_delta)) / coalesce(cu_limit, 200000)::DOUBLE * 100 AS margin FROM v)
 SELECT doc_id, cu_limit, cu_usage, cu_delta, round(margin, 6) AS margin_pct, CASE WHEN NOT sets_limit THEN 'Unknown' WHEN margin > 20 THEN 'Safe' WHEN margin > 10 THEN 'Moderate' ELSE 'High' END AS cu_risk FROM m""")
def compute_budget(spark, sf):
    out = scores.compute_budget(
        table(spark, sf, "documents"), "text", {"tion": 1000, "ment": 100, "ing ": 90}, {"and": 2, "le ": 5}, ("the", "der "), "token|mail")
    return out.select("doc_id", "cu_limit", "cu_usage", "cu_delta", F.round("margin_pct", 6).alias("margin_pct"), "cu_risk")


@query("assessment_score", """SELECT l_orderkey, CAST(least(100, sum(CASE least(5, l_linenumber) WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 8 ELSE 10 END) * 100 // 320) AS INTEGER) AS score FROM lineitem GROUP BY l_orderkey""")
def assessment_score(spark, sf):
    # flags of an assessment are counted per severity first, so a hot target stays five numbers
    names = ["Info", "Low", "Medium", "High", "Critical"]
    sev = F.least(F.lit(5), F.col("l_linenumber"))
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        *[F.sum((sev == i + 1).cast("int")).alias(n) for i, n in enumerate(names)])
    return counts.select("l_orderkey", scores.assessment_score_of_counts({n: F.col(n) for n in names}).alias("score"))


ASSESS_SQL = """assess AS (SELECT o_orderkey AS target, o_custkey AS analyst FROM orders), conf AS (SELECT l_orderkey AS target, l_suppkey AS analyst FROM lineitem),
 analysts AS (SELECT c_custkey AS analyst, CAST(greatest(0, floor(c_acctbal)) AS INTEGER) AS reputation_bps FROM customer),
 counted AS (SELECT target, count(DISTINCT conf.analyst) AS n FROM conf JOIN assess USING (target) WHERE conf.analyst <> assess.analyst GROUP BY target),
 confirmed AS (SELECT a.target, a.analyst, coalesce(n, 0) AS confirmations, CAST(least(100, reputation_bps * 50 // 10000 + least(coalesce(n, 0) * 10, 50)) AS INTEGER) AS confidence,
   CASE WHEN coalesce(n, 0) >= 1 THEN 'Confirmed' ELSE 'Pending' END AS status FROM assess a LEFT JOIN counted USING (target) LEFT JOIN analysts USING (analyst))"""


def _confirmed(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("target"), F.col("o_custkey").alias("analyst"))
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_suppkey").alias("analyst"))
    who = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("analyst"), F.greatest(F.lit(0), F.floor("c_acctbal")).cast("int").alias("reputation_bps"))
    return scores.confirm_assessments(a, c, who), who


@query("confirm_assessments", f"WITH {ASSESS_SQL} SELECT * FROM confirmed")
def confirm_assessments(spark, sf):
    return _confirmed(spark, sf)[0]


@query("reputation_after", f"""WITH {ASSESS_SQL} SELECT analyst, CAST(least(reputation_bps + coalesce(n, 0) * 100, 10000) AS INTEGER) AS reputation_bps
 FROM analysts LEFT JOIN (SELECT analyst, sum(confirmations) AS n FROM confirmed GROUP BY analyst) USING (analyst)""")
def reputation_after(spark, sf):
    done, who = _confirmed(spark, sf)
    return scores.reputation_after(done, who)


MATURE = list(scores.MATURITY)
MATURE_SQL = " + ".join(f"CASE WHEN (p_size + {i}) % 3 = 0 THEN {w} ELSE 0 END" for i, w in enumerate(scores.MATURITY.values()))


@query("maturity", f"SELECT p_partkey, round((p_size / 50.0::DOUBLE * 2.0::DOUBLE + {MATURE_SQL}) / {sum(scores.MATURITY.values()) + 2.0}::DOUBLE, 6) AS maturity FROM part")
def maturity(spark, sf):
    df = table(spark, sf, "part").withColumns({n: (F.col("p_size") + i) % 3 == 0 for i, n in enumerate(MATURE)})
    df = df.withColumn("typed_ratio", F.col("p_size") / 50.0)
    return df.select("p_partkey", F.round(scores.maturity(), 6).alias("maturity"))


# --- votes, metrics, timing ---------------------------------------------------------------------

VOTES_SQL = """votes AS (SELECT user_id AS finding_id, event_type AS model, CASE WHEN value < 20 THEN 'CONFIRMED' WHEN value < 60 THEN 'REJECTED' ELSE 'UNCERTAIN' END AS verdict,
 least(1.0::DOUBLE, floor(value) / 100) AS confidence FROM events), models AS (SELECT * FROM (VALUES ('click', 1.5), ('view', 0.5), ('error', 2.0)) v(model, weight))"""


@query("consensus", f"""WITH {VOTES_SQL}, a AS (SELECT finding_id, count(*) AS n_votes, sum(CASE WHEN verdict = 'CONFIRMED' THEN coalesce(weight, 1.0) ELSE 0 END)::DOUBLE AS c,
 sum(CASE WHEN verdict = 'REJECTED' THEN coalesce(weight, 1.0) ELSE 0 END)::DOUBLE AS r, sum(coalesce(weight, 1.0))::DOUBLE AS w, sum(coalesce(weight, 1.0)::DOUBLE * confidence::DOUBLE) AS wc FROM votes LEFT JOIN models USING (model) GROUP BY finding_id),
 f AS (SELECT *, greatest(c, r) / w AS agreement, wc / w AS conf FROM a)
 SELECT finding_id, n_votes, CASE WHEN c > r AND agreement >= 0.6 THEN 'CONFIRMED' WHEN r > c AND agreement >= 0.6 THEN 'REJECTED' ELSE 'UNCERTAIN' END AS verdict, round(agreement, 8) AS agreement, round(conf, 8) AS confidence,
 (c > r AND agreement >= 0.6 AND conf >= 0.2) AS should_report FROM f""")
def consensus(spark, sf):
    v = F.col("value")
    votes = table(spark, sf, "events").select(
        F.col("user_id").alias("finding_id"), F.col("event_type").alias("model"),
        F.when(v < 20, "CONFIRMED").when(v < 60, "REJECTED").otherwise("UNCERTAIN").alias("verdict"),
        F.least(F.lit(1.0), F.floor(v) / 100).alias("confidence"))
    models = spark.createDataFrame([("click", 1.5), ("view", 0.5), ("error", 2.0)], "model string, weight double")
    out = aggregates.consensus(votes, models, floor=0.2)
    return out.withColumns({"agreement": F.round("agreement", 8), "confidence": F.round("confidence", 8)})


@query("metrics", """SELECT event_type, date_trunc('day', ts) AS day, count(v) AS count, sum(v)::BIGINT AS sum_ms, (sum(v) // count(v))::BIGINT AS avg_ms, min(v) AS min_ms, max(v) AS max_ms
 FROM (SELECT event_type, ts, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY ALL""")
def metrics(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"),
                                          F.floor("value").alias("value_ms"))
    return aggregates.metrics(e, ["event_type", "day"])


@query("phase_report", """WITH p AS (SELECT o_custkey AS run, o_orderpriority AS phase, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS duration_ms, count(*) AS findings, max(o_orderkey) AS seq FROM orders GROUP BY ALL)
 SELECT run, count(*) AS phases, sum(duration_ms)::BIGINT AS total_ms, sum(findings)::BIGINT AS total_findings, arg_max(phase, {'a': duration_ms, 'b': seq}) AS slowest_phase, arg_max(phase, {'a': findings, 'b': seq}) AS most_productive_phase FROM p GROUP BY run""")
def phase_report(spark, sf):
    p = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("phase")).agg(
        F.sum(F.floor("o_totalprice")).alias("duration_ms"), F.count(F.lit(1)).alias("findings"), F.max("o_orderkey").alias("seq"))
    return aggregates.phase_report(p, ["run"])


@query("degrees", """SELECT 'p' || p_partkey AS node, (SELECT 0)::BIGINT + coalesce(o, 0) AS out_degree, coalesce(i, 0)::BIGINT AS in_degree FROM part
 LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) FILTER (l_returnflag <> 'A') AS o, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS i FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def degrees(spark, sf):
    from auditlake.catalog.base import call_edges

    nodes = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return aggregates.degrees(nodes, call_edges(spark, sf))


@query("graph_summary", """WITH e AS (SELECT DISTINCT l_returnflag, l_partkey, l_suppkey FROM lineitem)
 SELECT (SELECT count(*) FROM part) AS programs, (SELECT count(*) FROM e) AS calls, (SELECT count(*) FROM e WHERE l_partkey % 100 >= 50) AS risky_calls,
 (SELECT count(*) FROM part WHERE p_size <= 10) AS unverified, (SELECT max(l_partkey % 100) FROM e)::BIGINT AS max_risk""")
def graph_summary(spark, sf):
    nodes = table(spark, sf, "part").select((F.col("p_size") > 10).alias("verified"))
    edges = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey").distinct()
    return aggregates.graph_summary(nodes, edges.withColumn("risk", F.col("l_partkey") % 100))


@query("cpi_risk", """WITH e AS (SELECT DISTINCT l_partkey AS caller, l_suppkey AS callee, CASE l_returnflag WHEN 'A' THEN 'RawInvoke' WHEN 'R' THEN 'AnchorCPI' ELSE 'Other' END AS call_type FROM lineitem),
 n AS (SELECT s_suppkey AS callee, s_acctbal > 3000 AS verified, s_nationkey % 2 = 0 AS is_upgradeable, CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal / 100) AS INTEGER) END AS sc FROM supplier),
 r0 AS (SELECT *, CASE call_type WHEN 'RawInvoke' THEN 80 WHEN 'AnchorCPI' THEN 30 ELSE 50 END AS r FROM e JOIN n USING (callee)),
 r1 AS (SELECT * REPLACE (CASE WHEN NOT verified THEN least(floor(r * 1.3::DOUBLE), 100) ELSE r END AS r) FROM r0), r2 AS (SELECT * REPLACE (CASE WHEN is_upgradeable THEN least(floor(r * 1.2::DOUBLE), 100) ELSE r END AS r) FROM r1),
 r3 AS (SELECT * REPLACE (CASE WHEN sc < 50 THEN least(floor(r * 1.4::DOUBLE), 100) ELSE r END AS r) FROM r2)
 SELECT caller, callee, call_type, CAST(r AS INTEGER) AS risk FROM r3 WHERE r > 20""")
def cpi_risk(spark, sf):
    flag = F.col("l_returnflag")
    e = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee"),
        F.when(flag == "A", "RawInvoke").when(flag == "R", "AnchorCPI").otherwise("Other").alias("call_type")).distinct()
    n = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("program_id"), (F.col("s_acctbal") > 3000).alias("verified"), (F.col("s_nationkey") % 2 == 0).alias("is_upgradeable"),
        F.when(F.col("s_acctbal") > 0, F.floor(F.col("s_acctbal") / 100).cast("int")).alias("security_score"))
    return lookups.cpi_risk(e, n)


@query("assess_transactions", """WITH t AS (SELECT l_orderkey AS tx_id, CASE WHEN l_linenumber = 7 THEN 'short' ELSE 'Program' || lpad(CAST(l_suppkey AS VARCHAR), 20, '0') END AS program_id FROM lineitem),
 s AS (SELECT 'Program' || lpad(CAST(s_suppkey AS VARCHAR), 20, '0') AS program_id, s_nationkey = 3 AS safe, CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal / 100) AS INTEGER) END AS score FROM supplier),
 r AS (SELECT tx_id, CASE WHEN length(program_id) NOT BETWEEN 20 AND 60 THEN 50 WHEN safe THEN 0 WHEN score IS NOT NULL THEN greatest(100 - score, 0) ELSE 50 END AS risk FROM t LEFT JOIN s USING (program_id))
 SELECT tx_id, count(*) AS n_programs, CAST(sum(risk) // count(*) AS INTEGER) AS overall_risk, CAST(max(risk) AS INTEGER) AS max_risk, (sum(risk) // count(*) <= 40 AND max(risk) < 80) AS is_safe FROM r GROUP BY tx_id""")
def assess_transactions(spark, sf):
    pid = lambda c: F.concat(F.lit("Program"), F.lpad(F.col(c).cast("string"), 20, "0"))
    t = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tx_id"), F.when(F.col("l_linenumber") == 7, "short").otherwise(pid("l_suppkey")).alias("program_id"))
    s = table(spark, sf, "supplier")
    safe = s.filter("s_nationkey = 3").select(pid("s_suppkey").alias("program_id"))
    board = s.filter("s_acctbal > 0").select(pid("s_suppkey").alias("program_id"), F.floor(F.col("s_acctbal") / 100).cast("int").alias("score"))
    return lookups.assess_transactions(t, safe, board)


# --- evaluation ---------------------------------------------------------------------------------

TRUTH_SQL = """truth AS (SELECT 'P' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS program, CASE s_nationkey % 3 WHEN 0 THEN 'EXPLOITED' WHEN 1 THEN 'CLEAN' ELSE 'PRODUCTION' END AS category,
 CASE WHEN s_nationkey % 3 = 0 THEN ['SOL-0' || lpad(CAST(1 + s_suppkey % 90 AS VARCHAR), 2, '0'), 'SOL-100'] ELSE [] END AS expected_detections, s_nationkey = 6 AS semantic_exploit FROM supplier),
 lab AS (SELECT f.*, CASE WHEN id = 'SOL-017' AND contains(function_name, 'a') THEN 'TP'
  WHEN t.category = 'EXPLOITED' THEN CASE WHEN list_contains(expected_detections, id) OR (severity >= 4 AND confidence >= 60) THEN 'TP' WHEN severity >= 3 THEN 'INFO' ELSE 'FP' END
  WHEN t.category = 'CLEAN' THEN CASE WHEN severity >= 4 AND confidence >= 70 THEN 'FP' WHEN severity >= 3 THEN 'INFO' ELSE 'FP' END
  ELSE CASE WHEN severity >= 4 AND confidence >= 65 THEN 'TP' WHEN severity >= 3 THEN 'INFO' ELSE 'FP' END END AS verdict
  FROM findings f JOIN truth t USING (program))"""


def truth(spark, sf):
    n = F.col("s_nationkey")
    rule = F.concat(F.lit("SOL-0"), F.lpad((F.col("s_suppkey") % 90 + 1).cast("string"), 2, "0"))
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("P"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("program"),
        F.when(n % 3 == 0, "EXPLOITED").when(n % 3 == 1, "CLEAN").otherwise("PRODUCTION").alias("category"),
        F.when(n % 3 == 0, F.array(rule, F.lit("SOL-100"))).otherwise(F.array().cast("array<string>")).alias("expected_detections"),
        (n == 6).alias("semantic_exploit"))


def _flash(spark, sf):
    # rows whose function name contains 'a' play the flash-loan functions
    f = findings(spark, sf)
    return f.withColumn("function_name", F.when(F.contains("function_name", F.lit("a")), "flash").otherwise(F.col("function_name")))


@query("classify_findings", f"{WITH}, {TRUTH_SQL} SELECT program, id, verdict, count(*) AS n FROM lab GROUP BY ALL")
def classify_findings(spark, sf):
    return evaluate.classify_findings(_flash(spark, sf), truth(spark, sf)).groupBy("program", "id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("evaluate", f"""{WITH}, {TRUTH_SQL}, t AS (SELECT count(*) FILTER (verdict = 'TP') AS tp, count(*) FILTER (verdict = 'FP') AS fp, count(*) FILTER (verdict = 'INFO') AS info FROM lab),
 st AS (SELECT count(*) AS static_exploited, count(*) FILTER (EXISTS (SELECT 1 FROM findings f WHERE f.program = truth.program AND list_contains(truth.expected_detections, f.id))) AS static_detected
  FROM truth WHERE category = 'EXPLOITED' AND NOT semantic_exploit AND len(expected_detections) > 0), z AS (SELECT *, tp / (tp + fp) AS p, static_detected / static_exploited AS r FROM t, st)
 SELECT tp, fp, info, static_exploited, static_detected, round(p * 100, 1) AS precision, round(r * 100, 1) AS recall, round(2 * p * r / (p + r) * 100, 1) AS f1 FROM z""")
def evaluate_query(spark, sf):
    return evaluate.evaluate(_flash(spark, sf), truth(spark, sf))


@query("per_detector", f"""{WITH}, {TRUTH_SQL} SELECT id, count(*) AS total, count(*) FILTER (verdict = 'TP') AS tp, count(*) FILTER (verdict = 'FP') AS fp, count(*) FILTER (verdict = 'INFO') AS info,
 round(CASE WHEN count(*) FILTER (verdict <> 'INFO') = 0 THEN 1.0 ELSE count(*) FILTER (verdict = 'TP') / count(*) FILTER (verdict <> 'INFO') END, 4) AS precision FROM lab GROUP BY id""")
def per_detector(spark, sf):
    return evaluate.per_detector(evaluate.classify_findings(_flash(spark, sf), truth(spark, sf)))


@query("recall_by_program", f"""{WITH}, {EXPECTED_SQL}, m AS (SELECT e.*, {MATCHED} AS hit FROM expected e)
 SELECT program, count(*) AS expected, count(*) FILTER (hit) AS found, round(count(*) FILTER (hit) / count(*) * 100, 1) AS recall, count(*) FILTER (hit) / count(*) * 100 >= 70 AS passes FROM m GROUP BY program""")
def recall_by_program(spark, sf):
    floors = programs(spark, sf).select("program", F.lit(70.0).alias("floor"))
    return evaluate.recall_by_program(findings(spark, sf), expected_bugs(spark, sf), floors).drop("floor")


# --- fuzzy and advisory joins -------------------------------------------------------------------

LEGIT = ["blue-anvil", "red widgets", "cold bolt", "hot gera", "@small ring", "large_rod", "tiny gizmos", "green plate", "blue rings", "cold-anvil", "red-rod"]
LEGIT_SQL = "legit AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(LEGIT)) + ") v(pos, legit))"
NAMES_SQL = """names AS (SELECT DISTINCT replace(p_name, ' ', CASE WHEN p_size < 20 THEN '-' WHEN p_size < 35 THEN '_' ELSE ' ' END) AS name FROM part)"""
TYPO_SQL = f"""WITH {LEGIT_SQL}, {NAMES_SQL}, x AS (SELECT name, pos, legit, lower(name) = lower(legit) AS eq,
  lower(legit) IN (replace(lower(name), '-', '_'), replace(lower(name), '_', '-'), replace(lower(name), '@', '')) AS st,
  1 - levenshtein(lower(name), lower(legit)) / greatest(length(name), length(legit))::DOUBLE AS sim FROM names CROSS JOIN legit),
 g AS (SELECT name, min(pos) FILTER (eq) AS e, min(pos) FILTER (st AND NOT eq) AS s, arg_min(legit, pos) FILTER (st) AS st_legit,
  arg_max(legit, {{'a': sim, 'b': -pos}}) FILTER (sim > 0.75) AS best, max(sim) FILTER (sim > 0.75) AS best_sim FROM x GROUP BY name)
 SELECT name, CASE WHEN s IS NOT NULL THEN st_legit ELSE best END AS likely_target, round(CASE WHEN s IS NOT NULL THEN 0.95 ELSE best_sim END, 6) AS similarity
 FROM g WHERE (e IS NULL OR s < e) AND (s IS NOT NULL OR best IS NOT NULL)"""


def package_names(spark, sf):
    mark = F.when(F.col("p_size") < 20, "-").when(F.col("p_size") < 35, "_").otherwise(" ")
    return table(spark, sf, "part").select(F.replace("p_name", F.lit(" "), mark).alias("name"))


@query("typosquats", TYPO_SQL)
def typosquats(spark, sf):
    out = fuzzy.typosquats(package_names(spark, sf), LEGIT)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("typosquats_joined", TYPO_SQL)
def typosquats_joined(spark, sf):
    legit = spark.createDataFrame(list(enumerate(LEGIT)), "pos long, legit string")
    out = fuzzy.typosquats(package_names(spark, sf), legit)
    return out.withColumn("similarity", F.round("similarity", 6))


ADV_SQL = """adv AS (SELECT * FROM (VALUES ('A1', 'Blue Anvil', 'npm', ['1', '5', '7']), ('A2', 'cold bolt', 'Both', ['*']), ('A3', 'red rod', 'cargo', ['9', '12'])) v(id, package, ecosystem, versions))"""
ADVISORIES = [("A1", "Blue Anvil", "npm", ["1", " 5", "7"], "High", "t1"), ("A2", "cold bolt", "Both", ["*"], "Low", "t2"),
              ("A3", "red rod", "cargo", ["9", "12"], "Critical", "t3")]


@query("match_advisories", f"""WITH {ADV_SQL} SELECT p_partkey, p_name AS name, a.id AS advisory_id FROM part JOIN adv a ON lower(p_name) = lower(package)
 AND (ecosystem = 'Both' OR ecosystem = CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'cargo' END) AND (list_contains(versions, '*') OR list_contains(versions, CAST(p_size AS VARCHAR)))""")
def match_advisories(spark, sf):
    even = F.col("p_partkey") % 2 == 0
    deps = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.when(even, "npm").otherwise("cargo").alias("ecosystem"),
        F.concat(F.when(even, "^").otherwise(""), F.col("p_size").cast("string")).alias("version"))
    adv = spark.createDataFrame(ADVISORIES, "id string, package string, ecosystem string, affected_versions array<string>, severity string, title string")
    return lookups.match_advisories(deps, adv).select("p_partkey", "name", "advisory_id")


# --- coverage, anomaly, ensemble, benches -------------------------------------------------------

@query("coverage", """WITH kb AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN [] ELSE ['SOL-' || p_size] END AS d FROM part)
 SELECT count(*) AS entries, count(*) FILTER (len(d) > 0) AS covered, round(count(*) FILTER (len(d) > 0) / count(*) * 100, 1) AS coverage_pct FROM kb""")
def coverage(spark, sf):
    return aggregates.coverage(_kb(spark, sf))


def _kb(spark, sf):
    s = F.col("p_size")
    ids = F.when(s % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("SOL-"), s.cast("string"))))
    return table(spark, sf, "part").select("p_partkey", ids.alias("detector_ids"))


@query("coverage_gaps", "SELECT p_partkey FROM part WHERE p_size % 4 = 0")
def coverage_gaps(spark, sf):
    return aggregates.coverage_gaps(_kb(spark, sf)).select("p_partkey")


@query("by_owner", "SELECT p_brand AS owner, count(*) AS n_ids, min(p_partkey) AS first_id, max(p_partkey) AS last_id FROM part GROUP BY 1")
def by_owner(spark, sf):
    return aggregates.by_owner(table(spark, sf, "part").select(F.col("p_brand").alias("owner"), F.col("p_partkey").alias("id")))


BENCH_SQL = """runs AS (SELECT event_type AS name, count(*) AS iterations, avg(CAST(floor(value * 100) AS BIGINT)) AS mean_ms, arg_max(user_id, event_id) AS files, arg_max(CAST(length(props) AS BIGINT), event_id) AS findings FROM events GROUP BY 1)"""


def _bench(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("event_type").alias("name"), F.col("event_id").alias("run"), F.floor(F.col("value") * 100).alias("duration_ms"),
        F.col("user_id").alias("files"), F.length("props").cast("bigint").alias("findings"))
    return aggregates.bench_summary(runs)


@query("bench_summary", f"WITH {BENCH_SQL} SELECT name, iterations, round(mean_ms, 4) AS mean_ms, files, findings, round(files / (mean_ms / 1000.0::DOUBLE), 4) AS files_per_sec FROM runs")
def bench_summary(spark, sf):
    return _bench(spark, sf).withColumns({"mean_ms": F.round("mean_ms", 4), "files_per_sec": F.round("files_per_sec", 4)})


@query("bench_compare", f"WITH {BENCH_SQL} SELECT a.name AS baseline, b.name AS comparison, round(a.mean_ms / b.mean_ms, 6) AS speedup, b.findings - a.findings AS findings_diff FROM runs a JOIN runs b ON a.name = 'click' AND b.name IN ('view', 'error')")
def bench_compare(spark, sf):
    pairs = spark.createDataFrame([("click", "view"), ("click", "error")], "baseline string, comparison string")
    return aggregates.bench_compare(_bench(spark, sf), pairs).withColumn("speedup", F.round("speedup", 6))


@query("coverage_union", "SELECT l_suppkey, count(*) AS covered, bit_or(b) AS any_bits, count(*) / 4096::DOUBLE * 100 AS coverage_pct FROM (SELECT l_suppkey, l_partkey % 4096 AS pos, bit_or(l_linenumber) AS b FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def coverage_union(spark, sf):
    hits = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 4096).alias("pos"), F.col("l_linenumber").alias("byte"))
    return aggregates.coverage_union(hits, ["l_suppkey"], 4096)


@query("new_coverage", "SELECT l_suppkey, run, count(*) AS new_places FROM (SELECT l_suppkey, l_partkey AS pos, min(l_orderkey) AS run FROM lineitem GROUP BY ALL) GROUP BY ALL")
def new_coverage(spark, sf):
    hits = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_partkey").alias("pos"), F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("byte"))
    return aggregates.new_coverage(hits, ["l_suppkey"])


@query("distinct_paths", "SELECT event_type, count(DISTINCT sha256(props)) AS paths FROM events GROUP BY 1")
def distinct_paths(spark, sf):
    return aggregates.distinct_paths(table(spark, sf, "events"), ["event_type"], F.col("props"))


CRASH_SQL = "CASE event_type WHEN 'error' THEN 'integer overflow ' WHEN 'view' THEN 'index out of range ' WHEN 'click' THEN 'panic at ' WHEN 'signup' THEN 'memory ' ELSE 'other ' END || props"


@query("triage", f"""WITH c AS (SELECT event_id, {CRASH_SQL} AS error, CASE WHEN value > 50 THEN CAST(floor(value / 100) AS BIGINT) END AS code FROM events)
 SELECT sha256(error || ':' || coalesce(CAST(code AS VARCHAR), '')) AS fingerprint, CASE WHEN contains(error, 'overflow') THEN 'ArithmeticOverflow' WHEN contains(error, 'index out of range') THEN 'OutOfBounds'
  WHEN contains(error, 'panic') THEN 'Panic' WHEN contains(error, 'memory') THEN 'MemoryExhaustion' WHEN code IS NOT NULL THEN 'UnexpectedError' ELSE 'Crash' END AS crash_class, count(*) AS hits, min(event_id) AS first_seen
 FROM c GROUP BY 1, 2""")
def triage(spark, sf):
    t = F.col("event_type")
    text = F.when(t == "error", "integer overflow ").when(t == "view", "index out of range ").when(t == "click", "panic at ").when(t == "signup", "memory ").otherwise("other ")
    c = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(text, "props").alias("error"),
                                          F.when(F.col("value") > 50, F.floor(F.col("value") / 100)).alias("error_code"))
    return aggregates.triage(c)


@query("scan_stats", "SELECT lang, count(DISTINCT source) AS instructions, count(DISTINCT n_chars) AS accounts, count(DISTINCT doc_id) AS files, sum(len(string_split(rtrim(text, chr(10)), chr(10))))::BIGINT AS lines FROM documents GROUP BY lang")
def scan_stats(spark, sf):
    lines = F.size(F.split(F.rtrim(F.col("text"), F.lit("\n")), "\n"))
    return aggregates.scan_stats(table(spark, sf, "documents"), ["lang"], "source", "n_chars", "doc_id", lines)


@query("baseline_anomalies", """WITH s AS (SELECT l_suppkey, l_quantity, 'check_to_mutation_ratio' AS metric, count(*) FILTER (l_returnflag = 'A') / greatest(count(*) FILTER (l_returnflag = 'R'), 1) AS observed FROM lineitem GROUP BY 1, 2
 UNION ALL SELECT l_suppkey, l_quantity, 'signer_check_frequency', count(*) FILTER (l_linestatus = 'O') / count(*) FROM lineitem GROUP BY 1, 2),
 d AS (SELECT *, abs((observed - e) / e) AS dev FROM s JOIN (VALUES ('check_to_mutation_ratio', 1.2::DOUBLE), ('signer_check_frequency', 0.8::DOUBLE)) b(metric, e) USING (metric))
 SELECT l_suppkey, l_quantity, metric, round(dev, 6) AS deviation, CASE WHEN dev > 1.5 THEN 'High' WHEN dev > 1.0 THEN 'Medium' ELSE 'Low' END AS severity, round(least(0.95, dev / 2), 6) AS confidence FROM d WHERE dev > 0.75""")
def baseline_anomalies(spark, sf):
    li = table(spark, sf, "lineitem")
    flag = lambda c, v: F.count_if(F.col(c) == v)
    per = li.groupBy("l_suppkey", "l_quantity").agg((flag("l_returnflag", "A") / F.greatest(flag("l_returnflag", "R"), F.lit(1))).alias("check_to_mutation_ratio"),
                                      (flag("l_linestatus", "O") / F.count(F.lit(1))).alias("signer_check_frequency"))
    stats = per.unpivot(["l_suppkey", "l_quantity"], ["check_to_mutation_ratio", "signer_check_frequency"], "metric", "observed")
    base = spark.createDataFrame(list(aggregates.BASELINE.items()), "metric string, expected double")
    out = aggregates.baseline_anomalies(stats, base)
    return out.select("l_suppkey", "l_quantity", "metric", F.round("deviation", 6).alias("deviation"), "severity", F.round("confidence", 6).alias("confidence"))


@query("ensemble", """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 9 AS conf, CASE l_returnflag WHEN 'A' THEN 0.3::DOUBLE WHEN 'R' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS w,
 CASE least(5, l_linenumber) WHEN 5 THEN 1.2::DOUBLE WHEN 4 THEN 1.1::DOUBLE WHEN 3 THEN 1.0::DOUBLE WHEN 2 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS b FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(conf * (0.5::DOUBLE + w) * b, 0.99::DOUBLE), 6) AS confidence FROM f WHERE least(conf * (0.5::DOUBLE + w) * b, 0.99::DOUBLE) >= 0.4""")
def ensemble(spark, sf):
    n = F.least(F.lit(5), F.col("l_linenumber"))
    f = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 9).alias("confidence"), F.col("l_returnflag").alias("method"),
        F.when(n == 5, "Critical").when(n == 4, "High").when(n == 3, "Medium").when(n == 2, "Low").otherwise("Info").alias("severity"))
    weights = spark.createDataFrame([("A", 0.3), ("R", 0.2)], "method string, weight double")
    return aggregates.ensemble(f, weights, 0.4).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("confidence", 6).alias("confidence"))


@query("interval_profile", """WITH g AS (SELECT date_trunc('month', l_shipdate) AS month, l_returnflag, min(CAST(floor(l_extendedprice) AS BIGINT) - 2000) AS alo, max(CAST(floor(l_extendedprice) AS BIGINT) - 2000) AS ahi, min(CAST(l_quantity AS BIGINT) - 1) AS blo, max(CAST(l_quantity AS BIGINT) - 1) AS bhi FROM lineitem GROUP BY ALL)
 SELECT month, l_returnflag, alo + blo AS add_lo, ahi + bhi AS add_hi, alo - bhi AS sub_lo, ahi - blo AS sub_hi, least(alo*blo, alo*bhi, ahi*blo, ahi*bhi) AS mul_lo, greatest(alo*blo, alo*bhi, ahi*blo, ahi*bhi) AS mul_hi,
 blo <= 0 AND bhi >= 0 AS div_by_zero, alo - bhi < 0 AS may_negative FROM g""")
def interval_profile(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month"), "l_returnflag",
        (F.floor("l_extendedprice") - 2000).alias("price"), (F.col("l_quantity").cast("bigint") - 1).alias("qty"))
    p = aggregates.interval_profile(df, ["month", "l_returnflag"], "price", "qty")
    bounds = [F.col(f"{i}.{s}").cast("bigint").alias(f"{i}_{s}") for i in ("add", "sub", "mul") for s in ("lo", "hi")]
    return p.select("month", "l_returnflag", *bounds, "div_by_zero", "may_negative")
