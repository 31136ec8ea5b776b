"""Graph fixpoints, control and data flow, temporal properties and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.base import EDGES_SQL, STEPS_SQL, call_edges, query, table, user_graph
from auditlake.functions.numbers import cosine, norm
from auditlake.operators import code, graph, vectors
from auditlake.operators.temporal import Transitions


def part_node():
    return F.concat(F.lit("p"), F.col("p_partkey").cast("string"))


def supplier_node():
    return F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))


SOURCES_SQL = "sources AS (SELECT 'p' || p_partkey AS node, p_type AS label FROM part WHERE p_size = 7)"
SINKS_SQL = "sinks AS (SELECT 's' || s_suppkey AS node, CASE WHEN s_nationkey < 6 THEN 'StateWrite' WHEN s_nationkey < 12 THEN 'TokenTransfer' WHEN s_nationkey < 18 THEN 'CPIInvoke' ELSE 'ValidationBypass' END AS sink_kind FROM supplier)"


def sources(spark, sf):
    return table(spark, sf, "part").filter("p_size = 7").select(part_node().alias("node"), F.col("p_type").alias("label"))


def sinks(spark, sf):
    n = F.col("s_nationkey")
    kind = F.when(n < 6, "StateWrite").when(n < 12, "TokenTransfer").when(n < 18, "CPIInvoke").otherwise("ValidationBypass")
    return table(spark, sf, "supplier").select(supplier_node().alias("node"), kind.alias("sink_kind"))


LABELS_SQL = """seen(node, label, hops) AS (SELECT node, label, 0 FROM sources UNION SELECT e.dst, s.label, s.hops + 1 FROM seen s JOIN edges e ON e.src = s.node WHERE s.hops < 9),
 labels AS (SELECT node, label, min(hops) AS hops FROM seen GROUP BY ALL)"""


@query("reachable", f"WITH RECURSIVE {EDGES_SQL}, {SOURCES_SQL}, seen(node, hops) AS (SELECT DISTINCT node, 0 FROM sources UNION SELECT e.dst, s.hops + 1 FROM seen s JOIN edges e ON e.src = s.node WHERE s.hops < 9) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM seen GROUP BY node")
def reachable(spark, sf):
    return graph.reachable(call_edges(spark, sf), sources(spark, sf))


@query("reachable_depth", f"WITH RECURSIVE {EDGES_SQL}, {SOURCES_SQL}, seen(node, hops) AS (SELECT DISTINCT node, 0 FROM sources UNION SELECT e.dst, s.hops + 1 FROM seen s JOIN edges e ON e.src = s.node WHERE s.hops < 2) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM seen GROUP BY node")
def reachable_depth(spark, sf):
    return graph.reachable(call_edges(spark, sf), sources(spark, sf), depth=2)


@query("has_path", f"""WITH RECURSIVE {STEPS_SQL}, types AS (SELECT DISTINCT user_id, event_type AS t FROM events), seen(user_id, f, node) AS (SELECT user_id, t, t FROM types UNION SELECT s.user_id, f, e.dst FROM seen s JOIN edges e ON e.user_id = s.user_id AND e.src = s.node)
 SELECT a.user_id, a.t AS src, 'purchase' AS dst, EXISTS (SELECT 1 FROM seen s WHERE s.user_id = a.user_id AND s.f = a.t AND s.node = 'purchase') AS connected FROM types a""")
def has_path(spark, sf):
    edges, _ = user_graph(spark, sf)
    pairs = table(spark, sf, "events").select("user_id", F.col("event_type").alias("src")).distinct().withColumn("dst", F.lit("purchase"))
    return graph.has_path(edges, pairs, ["user_id"])


@query("reachable_avoiding", f"""WITH RECURSIVE {EDGES_SQL}, {SOURCES_SQL}, guards AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_nationkey >= 5),
 seen(node) AS (SELECT node FROM sources UNION SELECT e.dst FROM seen s JOIN edges e ON e.src = s.node WHERE e.dst NOT IN (SELECT node FROM guards)) SELECT node FROM seen""")
def reachable_avoiding(spark, sf):
    guards = table(spark, sf, "supplier").filter("s_nationkey >= 5").select(supplier_node().alias("node"))
    return graph.reachable_avoiding(call_edges(spark, sf), sources(spark, sf), guards)


@query("propagate_labels", f"""WITH RECURSIVE {EDGES_SQL}, {SOURCES_SQL}, clean AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_nationkey >= 20),
 seen(node, label, hops) AS (SELECT node, label, 0 FROM sources UNION SELECT e.dst, s.label, s.hops + 1 FROM seen s JOIN edges e ON e.src = s.node WHERE s.hops < 9 AND e.dst NOT IN (SELECT node FROM clean))
 SELECT node, label, CAST(min(hops) AS INTEGER) AS hops FROM seen GROUP BY ALL""")
def propagate_labels(spark, sf):
    clean = table(spark, sf, "supplier").filter("s_nationkey >= 20").select(supplier_node().alias("node"))
    out = graph.propagate_labels(call_edges(spark, sf), sources(spark, sf), clean)
    return out.select("node", "label", (F.size("path") - 1).alias("hops"))


@query("propagate_in_context", f"""WITH RECURSIVE {STEPS_SQL}, seen(user_id, node, label, c) AS (SELECT user_id, node, node, CAST([] AS VARCHAR[]) FROM entries
 UNION SELECT s.user_id, e.dst, s.label, CASE WHEN e.dst IN ('click', 'view') THEN s.c ELSE list_append(s.c, e.src)[-2:] END FROM seen s JOIN edges e ON e.user_id = s.user_id AND e.src = s.node)
 SELECT user_id, node, label, array_to_string(c, '>') AS context FROM seen""")
def propagate_in_context(spark, sf):
    edges, entries = user_graph(spark, sf)
    edges = edges.withColumn("site", F.when(~F.col("dst").isin("click", "view"), F.col("src")))
    out = graph.propagate_in_context(edges, entries.withColumn("label", F.col("node")), 2, ["user_id"])
    return out.select("user_id", "node", "label", F.array_join("context", ">").alias("context"))


@query("propagate_with_conditions", f"""WITH RECURSIVE {STEPS_SQL}, seen(user_id, node, label, c) AS (SELECT user_id, node, node, '' FROM entries
 UNION (WITH n AS (SELECT s.user_id, e.dst, s.label, s.c, CASE WHEN e.src IN ('error', 'signup') THEN 'after ' || e.src END AS ec FROM seen s JOIN edges e ON e.user_id = s.user_id AND e.src = s.node)
  SELECT user_id, dst, label, unnest(list_distinct([c, coalesce(ec, c)])) FROM n)) SELECT user_id, node, label, c AS condition FROM seen""")
def propagate_with_conditions(spark, sf):
    edges, entries = user_graph(spark, sf)
    edges = edges.withColumn("cond", F.when(F.col("src").isin("error", "signup"), F.concat(F.lit("after "), "src")))
    return graph.propagate_with_conditions(edges, entries.withColumn("label", F.col("node")), ["user_id"])


@query("taint_flows", f"""WITH RECURSIVE {EDGES_SQL}, {SOURCES_SQL}, {SINKS_SQL}, {LABELS_SQL}, k AS (SELECT node, hops, CASE label WHEN 'ECONOMY' THEN 'InstructionData' WHEN 'SMALL' THEN 'OracleData' ELSE label END AS label FROM labels)
 SELECT node, label, sink_kind, CASE WHEN sink_kind = 'ValidationBypass' THEN 'High' WHEN label = 'InstructionData' AND sink_kind = 'TokenTransfer' THEN 'Critical' WHEN label = 'InstructionData' AND sink_kind = 'StateWrite' THEN 'High' WHEN label = 'OracleData' AND sink_kind = 'StateWrite' THEN 'Medium' ELSE 'Low' END AS severity FROM k JOIN sinks USING (node)""")
def taint_flows(spark, sf):
    label = F.when(F.col("label") == "ECONOMY", "InstructionData").when(F.col("label") == "SMALL", "OracleData").otherwise(F.col("label"))
    labels = graph.propagate_labels(call_edges(spark, sf), sources(spark, sf).withColumn("label", label))
    return graph.taint_flows(labels, sinks(spark, sf)).select("node", "label", "sink_kind", "severity")


@query("backward_flows", f"""WITH RECURSIVE {STEPS_SQL}, seen(user_id, node, hops) AS (SELECT DISTINCT user_id, event_type, 0 FROM events WHERE event_type = 'purchase' UNION SELECT s.user_id, e.src, s.hops + 1 FROM seen s JOIN edges e ON e.user_id = s.user_id AND e.dst = s.node WHERE hops < 9)
 SELECT user_id, node, 'purchase' AS sink, CAST(min(hops) + 1 AS INTEGER) AS length FROM seen WHERE node IN ('signup', 'error') GROUP BY ALL""")
def backward_flows(spark, sf):
    edges, _ = user_graph(spark, sf)
    types = table(spark, sf, "events").select("user_id", F.col("event_type").alias("node")).distinct()
    out = graph.backward_flows(edges, types.filter("node = 'purchase'"), types.filter("node in ('signup', 'error')"), ["user_id"])
    return out.select("user_id", "node", "sink", F.size("path").alias("length"))


LIFT_SQL = """lifted AS (SELECT src, dst, starts_with(src, 's') AND CAST(src[2:] AS BIGINT) % 3 = 0 AS lifts FROM edges)"""


@query("raise_levels", f"""WITH RECURSIVE {EDGES_SQL}, {LIFT_SQL}, seeds AS (SELECT 'p' || p_partkey AS node, CASE WHEN p_size = 50 THEN 2 ELSE 0 END AS level FROM part),
 caps AS (SELECT 's' || s_suppkey AS node, 1 AS cap FROM supplier WHERE s_nationkey = 9),
 seen(node, level) AS (SELECT node, level FROM seeds UNION SELECT l.dst, least(CASE WHEN l.lifts AND s.level >= 2 THEN greatest(s.level, 3) ELSE s.level END, coalesce(c.cap, 9)) FROM seen s JOIN lifted l ON l.src = s.node LEFT JOIN caps c ON c.node = l.dst)
 SELECT node, CAST(max(level) AS INTEGER) AS level FROM seen GROUP BY node""")
def raise_levels(spark, sf):
    edges = call_edges(spark, sf)
    lifts = F.col("src").startswith("s") & (F.substring("src", 2, 20).cast("bigint") % 3 == 0)
    seeds = table(spark, sf, "part").select(part_node().alias("node"), F.when(F.col("p_size") == 50, 2).otherwise(0).alias("level"))
    caps = table(spark, sf, "supplier").filter("s_nationkey = 9").select(supplier_node().alias("node"), F.lit(1).alias("cap"))
    return graph.raise_levels(edges.withColumn("lifts", F.coalesce(lifts, F.lit(False))), seeds, caps=caps)


FLOW_SQL = """flows AS (SELECT user_id, src, dst FROM edges), bound AS (SELECT user_id, dst AS node FROM flows UNION SELECT user_id, node FROM seeds0),
 lab(user_id, node, level) AS (SELECT user_id, node, level FROM seeds0 UNION SELECT DISTINCT user_id, src, 4 FROM flows f WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.user_id = f.user_id AND b.node = f.src) UNION SELECT user_id, dst, 0 FROM flows),
 seen(user_id, node, level) AS (SELECT * FROM lab UNION SELECT s.user_id, f.dst, least(s.level, CASE WHEN f.dst = 'view' THEN 2 ELSE 9 END) FROM seen s JOIN flows f ON f.user_id = s.user_id AND f.src = s.node),
 levels AS (SELECT user_id, node, CAST(max(level) AS INTEGER) AS level FROM seen GROUP BY ALL)"""
FLOW_SEEDS = "seeds0 AS (SELECT user_id, node, CASE node WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS level FROM entries)"


def _flow_labels(spark, sf):
    flows, entries = user_graph(spark, sf)
    seeds = entries.withColumn("level", F.when(F.col("node") == "signup", 3).when(F.col("node") == "click", 2).otherwise(1))
    caps = flows.filter("dst = 'view'").select("user_id", F.col("dst").alias("node"), F.lit(2).alias("cap")).distinct()
    return graph.flow_labels(flows.filter("dst <> 'purchase'"), seeds, flows.filter("dst = 'purchase'"), caps, ["user_id"])


@query("flow_labels", f"WITH RECURSIVE {STEPS_SQL}, {FLOW_SEEDS}, {FLOW_SQL} SELECT * FROM levels")
def flow_labels(spark, sf):
    return _flow_labels(spark, sf)


@query("flow_violations", f"""WITH RECURSIVE {STEPS_SQL}, {FLOW_SEEDS}, {FLOW_SQL}, sk AS (SELECT DISTINCT user_id, event_type AS node, CASE WHEN event_type = 'purchase' THEN 1 ELSE 3 END AS max_level FROM events)
 SELECT user_id, node, CAST(max_level AS INTEGER) AS max_level, CAST(coalesce(level, 4) AS INTEGER) AS level FROM sk LEFT JOIN levels USING (user_id, node) WHERE coalesce(level, 4) > max_level""")
def flow_violations(spark, sf):
    sk = table(spark, sf, "events").select("user_id", F.col("event_type").alias("node")).distinct()
    sk = sk.withColumn("max_level", F.when(F.col("node") == "purchase", 1).otherwise(3))
    return graph.flow_violations(_flow_labels(spark, sf), sk, ["user_id"])


# --- control flow on each user's event graph ------------------------------------------------------

DOM_SQL = """reach(user_id, node) AS (SELECT * FROM entries UNION SELECT r.user_id, e.dst FROM reach r JOIN edges e ON e.user_id = r.user_id AND e.src = r.node),
 free(user_id, d, node) AS (SELECT r.user_id, r.node, n.node FROM reach r JOIN entries n USING (user_id) WHERE r.node <> n.node
  UNION SELECT f.user_id, f.d, e.dst FROM free f JOIN edges e ON e.user_id = f.user_id AND e.src = f.node WHERE e.dst <> f.d),
 doms AS (SELECT a.user_id, a.node, b.node AS dom FROM reach a JOIN reach b USING (user_id) WHERE NOT EXISTS (SELECT 1 FROM free f WHERE f.user_id = a.user_id AND f.d = b.node AND f.node = a.node))"""


def _doms(spark, sf):
    edges, entries = user_graph(spark, sf)
    return edges, graph.dominators(edges, entries, ["user_id"])


@query("dominators", f"WITH RECURSIVE {STEPS_SQL}, {DOM_SQL} SELECT user_id, node, dom FROM doms")
def dominators(spark, sf):
    return _doms(spark, sf)[1]


@query("immediate_dominators", f"""WITH RECURSIVE {STEPS_SQL}, {DOM_SQL}, n AS (SELECT user_id, node AS dom, count(*) AS c FROM doms GROUP BY ALL)
 SELECT d.user_id, d.node, arg_max(d.dom, n.c) AS idom FROM doms d JOIN n ON n.user_id = d.user_id AND n.dom = d.dom WHERE d.node <> d.dom GROUP BY ALL""")
def immediate_dominators(spark, sf):
    return graph.immediate_dominators(_doms(spark, sf)[1], ["user_id"])


BACK_SQL = "backs AS (SELECT e.user_id, e.src AS tail, e.dst AS header FROM edges e JOIN doms d ON d.user_id = e.user_id AND d.node = e.src AND d.dom = e.dst)"


@query("back_edges", f"WITH RECURSIVE {STEPS_SQL}, {DOM_SQL}, {BACK_SQL} SELECT * FROM backs")
def back_edges(spark, sf):
    edges, doms = _doms(spark, sf)
    return graph.back_edges(edges, doms, ["user_id"])


@query("natural_loops", f"""WITH RECURSIVE {STEPS_SQL}, {DOM_SQL}, {BACK_SQL}, body(user_id, tail, header, node) AS (SELECT user_id, tail, header, tail FROM backs UNION SELECT user_id, tail, header, header FROM backs
  UNION SELECT b.user_id, b.tail, b.header, e.src FROM body b JOIN edges e ON e.user_id = b.user_id AND e.dst = b.node WHERE b.node <> b.header) SELECT * FROM body""")
def natural_loops(spark, sf):
    edges, doms = _doms(spark, sf)
    return graph.natural_loops(edges, graph.back_edges(edges, doms, ["user_id"]), ["user_id"])


CODE_SQL = "CASE node WHEN 'purchase' THEN 'return x' WHEN 'signup' THEN 'for i in 0..n' ELSE 'step()' END"


@query("unbounded_loops", f"""WITH RECURSIVE {STEPS_SQL}, {DOM_SQL}, {BACK_SQL}, body(user_id, tail, header, node) AS (SELECT user_id, tail, header, tail FROM backs UNION SELECT user_id, tail, header, header FROM backs
  UNION SELECT b.user_id, b.tail, b.header, e.src FROM body b JOIN edges e ON e.user_id = b.user_id AND e.dst = b.node WHERE b.node <> b.header)
 SELECT user_id, tail, header, count(*) AS n_blocks FROM (SELECT *, {CODE_SQL} AS code FROM body) GROUP BY ALL HAVING NOT bool_or((node = header AND contains(code, '..')) OR contains(code, 'return'))""")
def unbounded_loops(spark, sf):
    edges, doms = _doms(spark, sf)
    loops = graph.natural_loops(edges, graph.back_edges(edges, doms, ["user_id"]), ["user_id"])
    text = F.when(F.col("node") == "purchase", "return x").when(F.col("node") == "signup", "for i in 0..n").otherwise("step()")
    blocks = loops.select("user_id", "node").distinct().withColumn("code", text)
    return graph.unbounded_loops(loops, blocks, ["user_id"]).drop("id")


@query("unguarded", f"""WITH RECURSIVE {STEPS_SQL}, {DOM_SQL}, b AS (SELECT DISTINCT user_id, 'process_' || (user_id % 5) AS fn, node FROM reach),
 g AS (SELECT user_id, node FROM b WHERE node = 'signup' AND user_id % 3 <> 0), s AS (SELECT * FROM b WHERE node IN ('purchase', 'click'))
 SELECT user_id, node, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.user_id = s.user_id) THEN 'SOL-CFG-01' ELSE 'SOL-CFG-02' END AS id FROM s
 WHERE NOT EXISTS (SELECT 1 FROM doms d JOIN g ON g.user_id = d.user_id AND g.node = d.dom WHERE d.user_id = s.user_id AND d.node = s.node)""")
def unguarded(spark, sf):
    edges, entries = user_graph(spark, sf)
    fn = F.concat(F.lit("process_"), (F.col("user_id") % 5).cast("string"))
    doms = graph.dominators(edges, entries, ["user_id"]).withColumn("fn", fn)
    blocks = doms.select("user_id", "fn", "node").distinct().withColumns({
        "is_guard": (F.col("node") == "signup") & (F.col("user_id") % 3 != 0), "is_sensitive": F.col("node").isin("purchase", "click")})
    return graph.unguarded(blocks, doms, ["user_id", "fn"]).select("user_id", "node", "id")


# --- data flow ------------------------------------------------------------------------------------

DEFS_SQL = """defs AS (SELECT user_id, event_type AS node, dayofweek(ts) AS var, min(event_id) AS def_id FROM events WHERE value >= 40 GROUP BY ALL),
 uses AS (SELECT user_id, event_type AS node, dayofweek(ts) AS var, min(event_id) AS use_id FROM events WHERE value < 40 GROUP BY ALL)"""


def defs_uses(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("node"), (F.dayofweek("ts") - 1).cast("bigint").alias("var"), "event_id", "value")
    keys = ["user_id", "node", "var"]
    return (e.filter("value >= 40").groupBy(*keys).agg(F.min("event_id").alias("def_id")),
            e.filter("value < 40").groupBy(*keys).agg(F.min("event_id").alias("use_id")))


REACH_SQL = """rd(user_id, node, var, def_id) AS (SELECT d.user_id, e.dst, d.var, d.def_id FROM defs d JOIN edges e ON e.user_id = d.user_id AND e.src = d.node
 UNION SELECT r.user_id, e.dst, r.var, r.def_id FROM rd r JOIN edges e ON e.user_id = r.user_id AND e.src = r.node WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.user_id = r.user_id AND d.node = r.node AND d.var = r.var))"""
LIVE_SQL = """lv(user_id, node, var) AS (SELECT u.user_id, e.src, u.var FROM uses u JOIN edges e ON e.user_id = u.user_id AND e.dst = u.node
 UNION SELECT l.user_id, e.src, l.var FROM lv l JOIN edges e ON e.user_id = l.user_id AND e.dst = l.node WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.user_id = l.user_id AND d.node = l.node AND d.var = l.var))"""
FLOW = f"WITH RECURSIVE {STEPS_SQL}, {DEFS_SQL}, {REACH_SQL}, {LIVE_SQL}"
KEY = ["user_id"]


def _reaching(spark, sf):
    defs, uses = defs_uses(spark, sf)
    return defs, uses, graph.reaching_definitions(user_graph(spark, sf)[0], defs, KEY)


@query("reaching_definitions", f"{FLOW} SELECT * FROM rd")
def reaching_definitions(spark, sf):
    return _reaching(spark, sf)[2]


@query("live_variables", f"{FLOW} SELECT * FROM lv")
def live_variables(spark, sf):
    defs, uses = defs_uses(spark, sf)
    return graph.live_variables(user_graph(spark, sf)[0], uses, defs, KEY)


@query("use_def", f"{FLOW} SELECT user_id, node, var, use_id, def_id FROM uses JOIN rd USING (user_id, node, var)")
def use_def(spark, sf):
    _, uses, rd = _reaching(spark, sf)
    return graph.use_def(uses, rd, KEY)


@query("uninitialized_uses", f"{FLOW} SELECT user_id, node, var, use_id FROM uses u WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.user_id = u.user_id AND rd.node = u.node AND rd.var = u.var)")
def uninitialized_uses(spark, sf):
    _, uses, rd = _reaching(spark, sf)
    return graph.uninitialized_uses(uses, rd, KEY)


@query("dead_definitions", f"{FLOW} SELECT user_id, node, var, def_id FROM defs d WHERE NOT EXISTS (SELECT 1 FROM lv WHERE lv.user_id = d.user_id AND lv.node = d.node AND lv.var = d.var)")
def dead_definitions(spark, sf):
    defs, uses = defs_uses(spark, sf)
    return graph.dead_definitions(defs, graph.live_variables(user_graph(spark, sf)[0], uses, defs, KEY), KEY)


@query("dataflow_findings", f"""{FLOW} SELECT user_id, node, var, 'DF-SOL-090' AS id, 3 AS severity, 40 AS confidence FROM uses u WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.user_id = u.user_id AND rd.node = u.node AND rd.var = u.var)
 UNION ALL SELECT user_id, node, var, 'DF-SOL-091', 1, 30 FROM defs d WHERE NOT EXISTS (SELECT 1 FROM lv WHERE lv.user_id = d.user_id AND lv.node = d.node AND lv.var = d.var)""")
def dataflow_findings(spark, sf):
    defs, uses, rd = _reaching(spark, sf)
    live = graph.live_variables(user_graph(spark, sf)[0], uses, defs, KEY)
    return graph.dataflow_findings(graph.uninitialized_uses(uses, rd, KEY), graph.dead_definitions(defs, live, KEY), KEY)


@query("value_flow", f"{FLOW}, c AS (SELECT user_id, node, var, use_id, def_id FROM uses JOIN rd USING (user_id, node, var)) SELECT use_id, user_id, node FROM c WHERE def_id = (SELECT min(def_id) FROM c)")
def value_flow(spark, sf):
    _, uses, rd = _reaching(spark, sf)
    chains = graph.use_def(uses, rd, KEY)
    first = chains.agg(F.min("def_id").alias("def_id"))
    return chains.join(F.broadcast(first), "def_id", "left_semi").select("use_id", "user_id", "node")


@query("liveness_intervals", f"{FLOW} SELECT user_id, var, min(node) AS first, max(node) AS last FROM lv GROUP BY ALL")
def liveness_intervals(spark, sf):
    defs, uses = defs_uses(spark, sf)
    return graph.liveness_intervals(graph.live_variables(user_graph(spark, sf)[0], uses, defs, KEY), KEY)


@query("field_tainted", """WITH u AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, [l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)] AS path FROM lineitem),
 m AS (SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['R'] WHEN 2 THEN ['A', 'O'] ELSE ['N', 'F', '3'] END AS mark FROM supplier)
 SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM u JOIN m ON l_suppkey = s_suppkey WHERE path[1:len(mark)] = mark""")
def field_tainted(spark, sf):
    uses = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("object"), "l_partkey", F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("path"))
    n = F.col("s_nationkey") % 4
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    mark = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, arr("R")).when(n == 2, arr("A", "O")).otherwise(arr("N", "F", "3"))
    marks = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("object"), mark.alias("path"))
    out = graph.field_tainted(uses, marks)
    return out.select("l_orderkey", "l_linenumber", F.col("object").alias("l_suppkey"), "l_partkey").distinct()


# --- blocks and aliasing --------------------------------------------------------------------------

@query("effects_after_calls", """WITH b AS (SELECT user_id AS fn, event_id AS block, event_type = 'click' AS c, event_type = 'purchase' AS m FROM events)
 SELECT fn, block, first_call, n AS n_calls_before FROM (SELECT *, min(CASE WHEN c THEN block END) OVER (PARTITION BY fn) AS first_call, count(*) FILTER (c) OVER (PARTITION BY fn ORDER BY block ROWS UNBOUNDED PRECEDING) AS n FROM b) WHERE m AND block > first_call""")
def effects_after_calls(spark, sf):
    b = table(spark, sf, "events").select(F.col("user_id").alias("fn"), F.col("event_id").alias("block"), (F.col("event_type") == "click").alias("is_call"),
                                          (F.col("event_type") == "purchase").alias("is_effect"))
    return code.effects_after_calls(b, bucket=F.floor(F.col("block") / 1000))


@query("alias_counts", """WITH f AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS x, CASE l_returnflag WHEN 'A' THEN 'any' WHEN 'R' THEN 'T' || l_linestatus END AS kind, l_quantity > 20 AS m, l_discount = 0 AS seeded, l_partkey FROM lineitem),
 p AS (SELECT a.g, a.m AS ma, b.m AS mb FROM f a JOIN f b ON a.g = b.g AND a.x < b.x WHERE NOT a.seeded AND NOT b.seeded AND (a.m OR b.m) AND (coalesce(a.kind = 'any', FALSE) OR coalesce(b.kind = 'any', FALSE) OR coalesce(a.kind = b.kind, FALSE)) AND NOT (a.x = 1 AND b.x = 2))
 SELECT g AS l_orderkey, (SELECT count(*) FROM p WHERE p.g = o.g AND ma AND mb) AS both_mutable, (SELECT count(*) FROM p WHERE p.g = o.g AND ma <> mb) AS one_mutable FROM (SELECT DISTINCT g FROM f WHERE NOT seeded) o""")
def alias_counts(spark, sf):
    from auditlake.operators.ordered import running_total

    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "any").when(F.col("l_returnflag") == "R", F.concat(F.lit("T"), "l_linestatus"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    numbered = running_total(li, "l_orderkey", order, F.lit(1).cast("bigint"), F.col("l_linenumber"), "field")
    fields = numbered.select(F.col("l_orderkey").alias("group"), "field", kind.alias("kind"), (F.col("l_quantity") > 20).alias("is_mutable"), (F.col("l_discount") == 0).alias("is_seeded"))
    links = fields.filter("field = 1").select("group", F.lit(1).cast("bigint").alias("a"), F.lit(2).cast("bigint").alias("b"))
    return code.alias_counts(fields, links).withColumnRenamed("group", "l_orderkey")


# --- temporal properties --------------------------------------------------------------------------

CTL_SQL = f"""WITH RECURSIVE {STEPS_SQL}, st AS (SELECT DISTINCT user_id, event_type AS state FROM events)"""


def _system(spark, sf):
    edges, entries = user_graph(spark, sf)
    e = table(spark, sf, "events")
    states = e.groupBy("user_id", F.col("event_type").alias("state")).agg(F.max(F.floor("value")).alias("top"), F.count(F.lit(1)).alias("n"))
    states = states.join(entries.select("user_id", F.col("node").alias("state"), F.lit(True).alias("_i")), ["user_id", "state"], "left").select(
        "user_id", "state", F.array(F.col("state"), F.when(F.col("n") > 10, "busy").otherwise("calm")).alias("labels"),
        F.create_map(F.lit("top"), F.col("top")).alias("balances"), F.coalesce("_i", F.lit(False)).alias("initial"))
    return Transitions(states, edges, ["user_id"])


TS_SQL = f"""WITH RECURSIVE {STEPS_SQL}, st AS (SELECT user_id, event_type AS state, CAST(max(floor(value)) AS BIGINT) AS top, count(*) > 10 AS busy FROM events GROUP BY ALL),
 tr AS (SELECT * FROM edges), deg AS (SELECT user_id, src, count(*) AS k FROM tr GROUP BY ALL)"""


@query("ctl_ef", f"{TS_SQL}, z(user_id, state) AS (SELECT user_id, state FROM st WHERE state = 'purchase' UNION SELECT t.user_id, t.src FROM z JOIN tr t ON t.user_id = z.user_id AND t.dst = z.state) SELECT * FROM z")
def ctl_ef(spark, sf):
    return _system(spark, sf).satisfying(("EF", ("prop", "purchase")))


@query("ctl_ax", f"{TS_SQL} SELECT user_id, state FROM st s WHERE NOT EXISTS (SELECT 1 FROM tr t JOIN st d ON d.user_id = t.user_id AND d.state = t.dst WHERE t.user_id = s.user_id AND t.src = s.state AND NOT d.busy)")
def ctl_ax(spark, sf):
    return _system(spark, sf).satisfying(("AX", ("prop", "busy")))


@query("ctl_ag", f"{TS_SQL}, bad(user_id, state) AS (SELECT user_id, state FROM st WHERE NOT (top >= 20 OR state = 'view') UNION SELECT t.user_id, t.src FROM bad JOIN tr t ON t.user_id = bad.user_id AND t.dst = bad.state) SELECT user_id, state FROM st WHERE (user_id, state) NOT IN (SELECT user_id, state FROM bad)")
def ctl_ag(spark, sf):
    return _system(spark, sf).satisfying(("AG", ("or", ("ge", "top", 20), ("prop", "view"))))


@query("ctl_eu", f"{TS_SQL}, z(user_id, state) AS (SELECT user_id, state FROM st WHERE state = 'view' UNION SELECT t.user_id, t.src FROM z JOIN tr t ON t.user_id = z.user_id AND t.dst = z.state JOIN st s ON s.user_id = t.user_id AND s.state = t.src AND s.busy) SELECT * FROM z")
def ctl_eu(spark, sf):
    return _system(spark, sf).satisfying(("EU", ("prop", "busy"), ("prop", "view")))


def _rounds(first, then, n=6):
    """Round-by-round SQL of a universal fixpoint: five states per graph settle in at most five rounds."""
    parts = [f"z0 AS ({first})"] + [f"z{i} AS ({then.replace('@', f'z{i - 1}')})" for i in range(1, n)]
    return ", ".join(parts), f"z{n - 1}"


ALL_NEXT = "SELECT user_id, state FROM st s WHERE NOT EXISTS (SELECT 1 FROM tr t WHERE t.user_id = s.user_id AND t.src = s.state AND (t.user_id, t.dst) NOT IN (SELECT user_id, state FROM @))"
AF_SQL = _rounds("SELECT user_id, state FROM st WHERE state = 'purchase'", f"SELECT * FROM @ UNION {ALL_NEXT}")
AU_SQL = _rounds("SELECT user_id, state FROM st WHERE state = 'view'", f"SELECT * FROM @ UNION SELECT x.* FROM ({ALL_NEXT}) x JOIN st USING (user_id, state) WHERE busy")
EG_SQL = _rounds("SELECT user_id, state FROM st WHERE busy", "SELECT DISTINCT z.user_id, z.state FROM @ z JOIN tr t ON t.user_id = z.user_id AND t.src = z.state JOIN @ y ON y.user_id = t.user_id AND y.state = t.dst")


@query("ctl_af", f"{TS_SQL}, {AF_SQL[0]} SELECT * FROM {AF_SQL[1]}")
def ctl_af(spark, sf):
    return _system(spark, sf).satisfying(("AF", ("prop", "purchase")))


@query("ctl_au", f"{TS_SQL}, {AU_SQL[0]} SELECT * FROM {AU_SQL[1]}")
def ctl_au(spark, sf):
    return _system(spark, sf).satisfying(("AU", ("prop", "busy"), ("prop", "view")))


@query("ctl_eg", f"{TS_SQL}, {EG_SQL[0]} SELECT * FROM {EG_SQL[1]}")
def ctl_eg(spark, sf):
    return _system(spark, sf).satisfying(("EG", ("prop", "busy")))


@query("ctl_check", f"""{TS_SQL}, sat AS (SELECT s.user_id, s.state FROM st s WHERE NOT s.busy AND EXISTS (SELECT 1 FROM tr t WHERE t.user_id = s.user_id AND t.src = s.state AND t.dst = 'view'))
 SELECT s.user_id, count(*) AS states, count(x.state) AS satisfying, NOT bool_or(n.node IS NOT NULL AND x.state IS NULL) AS holds, min(CASE WHEN n.node IS NOT NULL AND x.state IS NULL THEN s.state END) AS counterexample
 FROM st s LEFT JOIN sat x ON x.user_id = s.user_id AND x.state = s.state LEFT JOIN entries n ON n.user_id = s.user_id AND n.node = s.state GROUP BY s.user_id""")
def ctl_check(spark, sf):
    return _system(spark, sf).check(("and", ("not", ("prop", "busy")), ("EX", ("prop", "view"))))


# --- vectors --------------------------------------------------------------------------------------

CENTRE_SQL = "c AS (SELECT CAST(label AS VARCHAR) AS pattern, i, avg(v::DOUBLE) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)"


@query("nearest_patterns", f"""WITH {CENTRE_SQL}, x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
 d AS (SELECT vec_id, pattern, sum(x.v * c.v) / sqrt(sum(x.v * x.v)) / sqrt(sum(c.v * c.v)) AS s FROM x JOIN c USING (i) GROUP BY ALL), b AS (SELECT vec_id, arg_max(pattern, s) AS pattern, max(s) AS s FROM d GROUP BY vec_id)
 SELECT vec_id, pattern, round(s, 6) AS similarity, CASE WHEN s > 0.85 THEN 'Critical' WHEN s > 0.75 THEN 'High' ELSE 'Medium' END AS severity FROM b WHERE s > 0.2""")
def nearest_patterns(spark, sf):
    e = table(spark, sf, "embeddings")
    out = vectors.nearest_patterns(e, vectors.centroids(e, "label"), "vec_id", threshold=0.2)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("cosine", f"""WITH {CENTRE_SQL}, x AS (SELECT vec_id, CAST(label AS VARCHAR) AS pattern, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
 SELECT vec_id, round(sum(x.v * c.v) / sqrt(sum(x.v * x.v)) / sqrt(sum(c.v * c.v)), 6) AS similarity, round(sqrt(sum(x.v * x.v)), 6) AS length FROM x JOIN c USING (pattern, i) GROUP BY vec_id""")
def cosine_query(spark, sf):
    e = table(spark, sf, "embeddings")
    c = vectors.centroids(e, "label").withColumnRenamed("embedding", "centre")
    joined = e.withColumn("pattern", F.col("label").cast("string")).join(c, "pattern")
    return joined.select("vec_id", F.round(cosine(F.col("embedding"), F.col("centre")), 6).alias("similarity"), F.round(norm(F.col("embedding")), 6).alias("length"))


@query("vector_deviation", """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL)
 SELECT vec_id, round(sqrt(sum((v - m) * (v - m)) / 64), 6) AS deviation FROM x JOIN m USING (label, i) GROUP BY vec_id""")
def vector_deviation(spark, sf):
    out = vectors.vector_deviation(table(spark, sf, "embeddings"), "vec_id", "embedding", by="label")
    return out.select("vec_id", F.round("deviation", 6).alias("deviation"))


LAYER = lambda a, b: f"""{b}a AS (SELECT vec_id, i, sum(v) AS v FROM (SELECT vec_id, i, 2 * v AS v FROM {a} UNION ALL SELECT e.dst, {a}.i, {a}.v FROM g e JOIN {a} ON {a}.vec_id = e.src) GROUP BY ALL),
 {b} AS (SELECT vec_id, w.i, greatest(sum(w.w * {b}a.v), 0) AS v FROM {b}a JOIN w ON w.j = {b}a.i GROUP BY ALL)"""


@query("message_pass", f"""WITH w AS (SELECT i, j, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin((i + j) * 0.1::DOUBLE) * sqrt(2.0::DOUBLE / 128))) AS w FROM range(64) a(i), range(64) b(j)),
 x0 AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
 g AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT vec_id FROM embeddings) AND l_partkey IN (SELECT vec_id FROM embeddings)), {LAYER('x0', 'x1')}, {LAYER('x1', 'x2')}
 SELECT vec_id, round(sum(v), 4) AS total, round(max(v), 4) AS top FROM x2 GROUP BY vec_id""")
def message_pass(spark, sf):
    nodes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("features"))
    ids = nodes.select("node")
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    edges = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    out = vectors.message_pass(nodes, edges)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return out.select(F.col("node").alias("vec_id"), F.round(total, 4).alias("total"), F.round(F.array_max("features"), 4).alias("top"))


WEIGHTS = {"the": 0.9, "of": -0.3, "and": 0.5}
WEIGHT_SQL = "CASE tok WHEN 'the' THEN 0.9::DOUBLE WHEN 'of' THEN -0.3::DOUBLE WHEN 'and' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END"
LINES_SQL = f"""tx AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> ''),
 l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n FROM tx),
 t AS (SELECT doc_id, i, n, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS j FROM (SELECT *, string_split_regex(line, '[^\\p{{L}}\\p{{N}}]') AS ts FROM l)),
 v AS (SELECT doc_id, i, n, (j * 7) % 128 AS d, sum({WEIGHT_SQL}) AS v FROM t GROUP BY ALL), z AS (SELECT doc_id, i, sqrt(sum(v * v)) AS s FROM v GROUP BY ALL)"""


@query("embed", f"""WITH {LINES_SQL}, e AS (SELECT doc_id, d, sum(CASE WHEN s > 0 THEN v / s * (1.0::DOUBLE + 0.5::DOUBLE * i / n) ELSE 0 END) AS v FROM v JOIN z USING (doc_id, i) GROUP BY ALL),
 q AS (SELECT doc_id, sqrt(sum(v * v)) AS s FROM e GROUP BY doc_id) SELECT doc_id, coalesce(round(max(v / s), 6), 0) AS top, coalesce(round(sum(v / s), 6), 0) AS total FROM documents LEFT JOIN e USING (doc_id) LEFT JOIN q USING (doc_id) GROUP BY doc_id""")
def embed(spark, sf):
    out = vectors.embed(table(spark, sf, "documents").select("doc_id", "text"), WEIGHTS, "text")
    return out.select("doc_id", F.round(F.array_max("embedding"), 6).alias("top"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("nearest_lines", f"""WITH {LINES_SQL}, pt AS (SELECT CAST(item_id AS VARCHAR) AS pattern, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS j FROM (SELECT item_id, string_split_regex(text, '[^\\p{{L}}\\p{{N}}]') AS ts FROM benchmark)),
 pv AS (SELECT pattern, (j * 7) % 128 AS d, sum({WEIGHT_SQL}) AS v FROM pt GROUP BY ALL), pz AS (SELECT pattern, sqrt(sum(v * v)) AS s FROM pv GROUP BY pattern),
 k AS (SELECT doc_id, i FROM l WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' AND NOT regexp_matches(line, '^\\s*//')),
 c AS (SELECT v.doc_id, v.i, pv.pattern, round(sum(v.v * pv.v) / (any_value(z.s) * any_value(pz.s)), 12) AS s FROM k JOIN v USING (doc_id, i) JOIN z USING (doc_id, i) JOIN pv USING (d) JOIN pz USING (pattern) GROUP BY ALL)
 SELECT doc_id, pattern, (arg_min(i, {{'a': -s, 'b': i}}) + 1)::INT AS line_no, round(max(s), 6) AS similarity FROM c WHERE s > 0.5 GROUP BY doc_id, pattern""")
def nearest_lines(spark, sf):
    patterns = table(spark, sf, "benchmark").select(F.col("item_id").alias("pattern"), "text")
    out = vectors.nearest_lines(table(spark, sf, "documents"), patterns, "doc_id", "text", 0.5, WEIGHTS)
    return out.withColumn("similarity", F.round("similarity", 6))
