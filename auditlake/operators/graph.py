"""Graph fixpoints as rounds of joins.

Every loop is semi-naive: a round joins only the rows that were new in the last one, removes what is
already known with an anti-join and appends the rest to a written table, so a lost executor costs one
round at most and plans stay short. The driver sees row counts only. `keys` names the columns that
identify a graph (for example a function); all graphs advance together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from auditlake.functions.text import has_any
from auditlake.session import RoundTable, write_cut


def grow(
    start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], max_rounds: int | None = None, whole: bool = False,
    last: Callable[[DataFrame], DataFrame] | None = None, finish: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Closure of start under step; one row per key, taken from the first round that reaches it. With whole, rounds that end before
    the closure does are an error. last: prepares the rows of a round for the next one; finish: gives the new rows what step left out,
    from the rows that they came from."""
    table = RoundTable(start.sparkSession)
    new, rounds = table.append(start.dropDuplicates(keys)), 0
    while new and (max_rounds is None or rounds < max_rounds):
        known = table.all().select(*keys)
        frontier = last(table.last()) if last else table.last()
        found = step(frontier).dropDuplicates(keys).join(known, keys, "left_anti")
        found = finish(found, frontier) if finish else found
        new, rounds = table.append(found.select(*start.columns)), rounds + 1
    if new and whole:
        raise RuntimeError(f"not finished after {rounds} rounds: {new} rows are still new")
    return table.all()


def _edges(edges: DataFrame, keys, extra=(), forward: bool = True) -> DataFrame:
    """Distinct edges, cut from their plan once so that every round reads files."""
    src, dst = ("src", "dst") if forward else ("dst", "src")
    return write_cut(edges.select(*keys, F.col(src).alias("node"), F.col(dst).alias("_to"), *extra).distinct())


def _shortest(start: DataFrame, e: DataFrame, keys, label=(), longer=None, max_rounds: int | None = None, whole: bool = False) -> DataFrame:
    """grow over (keys, node, label, path): each row keeps the smallest of its shortest paths. longer(path, to) adds a node at the end
    or, for walks against the edges, at the front.

    Paths of a round are equally long and those that meet in a node get the same node added, so the order of their beginnings decides.
    Beginnings are put in order once and written; the join by edges, which makes a row for every edge and label, carries the place
    in that order as one number, and only rows that are new read their path."""
    ids = [*keys, "node", *label]

    def placed(rows):
        return write_cut(rows.orderBy("path").withColumn("_place", F.monotonically_increasing_id()))

    def step(rows):
        near = rows.select(*ids, "_place").join(e, [*keys, "node"])
        return near.groupBy(*keys, F.col("_to").alias("node"), *label).agg(F.min("_place").alias("_place"))

    def finish(found, rows):
        return found.join(rows.select("_place", "path"), "_place").withColumn("path", longer(F.col("path"), F.col("node")))

    return grow(start, step, ids, max_rounds, whole, placed, finish)


def _at_end(path: Column, to: Column) -> Column:
    return F.concat(path, F.array(to.cast("string")))


def _in_front(path: Column, to: Column) -> Column:
    return F.concat(F.array(to.cast("string")), path)


def reachable(edges: DataFrame, seeds: DataFrame, keys=(), label=(), depth: int | None = None, forward: bool = True) -> DataFrame:
    """Nodes reachable from seeds (keys, node, label columns carried along), with the round as `hops`.

    edges: keys, src, dst. The seeds themselves are at 0 hops.
    """
    keys, label = list(keys), list(label)
    e = _edges(edges, keys, forward=forward)
    start = seeds.select(*keys, "node", *label).distinct().withColumn("hops", F.lit(0))

    def step(frontier):
        near = frontier.join(e, [*keys, "node"])
        return near.select(*keys, F.col("_to").alias("node"), *label, (F.col("hops") + 1).alias("hops"))

    return grow(start, step, [*keys, "node", *label], depth)


def has_path(edges: DataFrame, pairs: DataFrame, keys=()) -> DataFrame:
    """Add `connected` to (keys, src, dst) pairs; sources are explored together."""
    keys = list(keys)
    seeds = pairs.select(*keys, F.col("src").alias("node"), F.col("src").alias("_from")).distinct()
    seen = reachable(edges, seeds, keys, ["_from"]).select(
        *keys, F.col("_from").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("_ok"))
    return pairs.join(seen, [*keys, "src", "dst"], "left").select(*pairs.columns, F.col("_ok").isNotNull().alias("connected"))


def reachable_avoiding(edges: DataFrame, seeds: DataFrame, guards: DataFrame, keys=()) -> DataFrame:
    """Reachable nodes when guard nodes are not passed through (a seed that is a guard still starts)."""
    keys = list(keys)
    blocked = guards.select(*keys, F.col("node")).distinct()
    e = _edges(edges, keys)
    open_edges = write_cut(e.join(blocked.withColumnRenamed("node", "_to"), [*keys, "_to"], "left_anti"))
    start = seeds.select(*keys, "node").distinct()

    def step(frontier):
        return frontier.join(open_edges, [*keys, "node"]).select(*keys, F.col("_to").alias("node"))

    return grow(start, step, [*keys, "node"])


def propagate_labels(
    edges: DataFrame, sources: DataFrame, sanitizers: DataFrame | None = None, keys=(), max_rounds: int | None = None
) -> DataFrame:
    """Labels along edges: one row per (node, label) with its shortest path (smallest one on ties).

    edges: keys, src, dst; sources: keys, node, label. Sanitizer nodes take no labels from others.
    """
    keys = list(keys)
    e = _edges(edges, keys)
    if sanitizers is not None:
        clean = sanitizers.select(*keys, F.col("node").alias("_to")).distinct()
        e = write_cut(e.join(clean, [*keys, "_to"], "left_anti"))
    start = sources.select(*keys, "node", "label").distinct().withColumn("path", F.array(F.col("node").cast("string")))
    return _shortest(start, e, keys, ["label"], _at_end, max_rounds, True)


def propagate_in_context(edges: DataFrame, sources: DataFrame, k: int = 3, keys=(), max_rounds: int | None = None) -> DataFrame:
    """Labels with their last k call sites. edges also carry `site` (null inside a function).

    Rows are keyed by (node, label, context): the same label under two call strings stays apart.
    """
    keys = list(keys)
    e = _edges(edges, keys, ["site"])
    start = sources.select(*keys, "node", "label").distinct().withColumn("context", F.array().cast("array<string>"))

    def step(frontier):
        pushed = F.concat("context", F.array(F.col("site").cast("string")))
        cut = F.slice(pushed, F.greatest(F.size(pushed) - k + 1, F.lit(1)), F.lit(k))
        return frontier.join(e, [*keys, "node"]).select(
            *keys, F.col("_to").alias("node"), "label", F.when(F.col("site").isNull(), F.col("context")).otherwise(cut).alias("context"))

    return grow(start, step, [*keys, "node", "label", "context"], max_rounds, True)


def propagate_with_conditions(edges: DataFrame, sources: DataFrame, keys=(), max_rounds: int | None = None) -> DataFrame:
    """Labels with every branch condition met on some path: rows (node, label, condition).

    edges carry `cond` (null without one). The row with condition '' says the label arrives at all.
    """
    keys = list(keys)
    e = _edges(edges, keys, ["cond"])
    start = sources.select(*keys, "node", "label").distinct().withColumn("condition", F.lit(""))

    def step(frontier):
        carried = F.array_distinct(F.array_compact(F.array(F.col("condition"), F.col("cond"))))
        return frontier.join(e, [*keys, "node"]).select(
            *keys, F.col("_to").alias("node"), "label", F.explode(carried).alias("condition"))

    return grow(start, step, [*keys, "node", "label", "condition"], max_rounds, True)


# Severity of a flow by source kind and sink kind.
FLOW_SEVERITY = {
    ("InstructionData", "LamportsTransfer"): "Critical", ("InstructionData", "TokenTransfer"): "Critical",
    ("UncheckedAccount", "CPIInvoke"): "Critical", ("InstructionData", "StateWrite"): "High",
    ("InstructionData", "AuthorityCheck"): "High", ("UserProvidedSeeds", "PDADerivation"): "High",
    ("OracleData", "StateWrite"): "Medium", ("DeserializedData", "UncheckedArithmetic"): "Medium",
}
BYPASS = "ValidationBypass"


def flow_severity(source: Column, sink: Column, table=FLOW_SEVERITY) -> Column:
    out = F.when(sink == BYPASS, "High").otherwise("Low")
    for (a, b), severity in table.items():
        out = F.when((source == a) & (sink == b), F.lit(severity)).otherwise(out)
    return out


def taint_flows(labels: DataFrame, sinks: DataFrame, keys=()) -> DataFrame:
    """Labels that arrive at sinks (keys, node, sink_kind), with the severity of the pair."""
    keys = list(keys)
    joined = labels.join(sinks.select(*keys, "node", "sink_kind").distinct(), [*keys, "node"])
    return joined.withColumn("severity", flow_severity(F.col("label"), F.col("sink_kind")))


def backward_flows(edges: DataFrame, sinks: DataFrame, sources: DataFrame, keys=()) -> DataFrame:
    """Sources found walking back from each sink, with the node path from source to sink."""
    keys = list(keys)
    e = _edges(edges, keys, forward=False)
    start = sinks.select(*keys, "node", F.col("node").alias("sink")).distinct().withColumn("path", F.array(F.col("node").cast("string")))
    seen = _shortest(start, e, keys, ["sink"], _in_front)
    return seen.join(sources.select(*keys, "node").distinct(), [*keys, "node"], "left_semi")


def raise_levels(
    edges: DataFrame, seeds: DataFrame | None, keys=(), lift_from: int = 2, lift_to: int = 3, caps: DataFrame | None = None, small: bool = False
) -> DataFrame:
    """Greatest level of every node: max over its incoming edges, to the fixpoint.

    edges: keys, src, dst, lifts (true: a level of lift_from or more becomes at least lift_to);
    seeds: keys, node, level; caps: keys, node, cap (a node never rises above its cap). Levels are a
    small finite range, so a node is written at most once per level. With small, a graph is no longer than a text that fits in a row
    (the variables of a function): the edges and seeds of each meet in one row and reach their fixpoint there, without rounds. Edges
    of small graphs may have `steps` instead, arrays of edges and seeds as level_step makes them; there are no other seeds then.
    """
    keys = list(keys)
    if small:
        if caps is not None or not keys:
            raise ValueError("small graphs have keys and no caps")
        return _levels_in_rows(edges, seeds, keys, lift_from, lift_to)
    e = _edges(edges, keys, ["lifts"])
    if caps is not None:
        c = caps.select(*keys, F.col("node").alias("_to"), "cap")
        e = write_cut(e.join(c, [*keys, "_to"], "left"))
    else:
        e = e.withColumn("cap", F.lit(None).cast("int"))
    spark = seeds.sparkSession
    table = RoundTable(spark)
    new = table.append(seeds.groupBy(*keys, "node").agg(F.max("level").cast("int").alias("level")))
    state = lambda: table.all().groupBy(*keys, "node").agg(F.max("level").alias("_now"))
    while new:
        near = table.last().join(e, [*keys, "node"])
        lifted = F.when(F.col("lifts") & (F.col("level") >= lift_from), F.greatest(F.col("level"), F.lit(lift_to))).otherwise(F.col("level"))
        moved = near.select(*keys, F.col("_to").alias("node"), F.least(lifted, F.col("cap")).cast("int").alias("level"))
        best = moved.groupBy(*keys, "node").agg(F.max("level").alias("level"))
        risen = best.join(state(), [*keys, "node"], "left").filter("_now is null or level > _now")
        new = table.append(risen.select(*keys, "node", "level"))
    return table.all().groupBy(*keys, "node").agg(F.max("level").alias("level"))


def level_step(node: Column, to: Column | None = None, lifts: Column | None = None, level: Column | None = None) -> Column:
    """An edge of a small graph (without a level), or a seed (without an end)."""
    none, no = F.lit(None), F.lit(False)
    return F.struct(
        node.cast("string").alias("node"), (none if to is None else to).cast("string").alias("to"), (no if lifts is None else F.coalesce(lifts, no)).alias("lifts"),
        (none if level is None else level).cast("int").alias("level"))


def _levels_in_rows(edges: DataFrame, seeds: DataFrame | None, keys: list[str], lift_from: int, lift_to: int) -> DataFrame:
    """raise_levels with one row for each graph while its levels rise. As in joins, edges without a key lead nowhere."""
    import pyarrow as pa

    def raised(graphs):
        ends, parts = graphs.offsets.to_pylist(), [graphs.values.field(i).to_pylist() for i in range(4)]
        sizes, nodes, levels = [0], [], []
        for a, b in zip(ends, ends[1:]):
            now, out, todo = {}, {}, []
            for node, to, lifts, level in zip(*(p[a:b] for p in parts)):
                if level is None:
                    out.setdefault(node, []).append((to, lifts))
                elif level > now.get(node, level - 1):
                    now[node] = level
            todo = [*now]
            while todo:
                node = todo.pop()
                for to, lifts in out.get(node, ()):
                    level = max(now[node], lift_to) if lifts and now[node] >= lift_from else now[node]
                    if level > now.get(to, level - 1):
                        now[to] = level
                        todo.append(to)
            nodes.extend(now)
            levels.extend(now.values())
            sizes.append(len(nodes))
        made = pa.StructArray.from_arrays([pa.array(nodes, pa.string()), pa.array(levels, pa.int32())], ["node", "level"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), made)

    raised.__annotations__ = {"graphs": pa.Array, "return": pa.Array}
    if "steps" in edges.columns:
        graphs, node_type = edges.groupBy(*keys).agg(F.flatten(F.collect_list("steps")).alias("_e")), "string"
    else:
        along = edges.dropna(subset=[*keys, "src", "dst"]).select(*keys, level_step(F.col("src"), F.col("dst"), F.col("lifts")).alias("_e"))
        start = seeds.where("level is not null").select(*keys, level_step(F.col("node"), level=F.col("level")).alias("_e"))
        graphs, node_type = along.unionByName(start).groupBy(*keys).agg(F.collect_list("_e").alias("_e")), seeds.schema["node"].dataType
    found = F.arrow_udf(raised, "array<struct<node:string,level:int>>")(F.col("_e"))
    # an inner generator would have the levels made once more, for a filter by their number
    rows = graphs.select(*keys, F.explode_outer(found).alias("_r")).where("_r is not null")
    return rows.select(*keys, F.col("_r.node").cast(node_type).alias("node"), "_r.level")


# Labels of typed information flow: 0 trusted, 1 runtime, 2 account data, 3 user input, 4 tainted.
TRUSTED, TOP = 0, 4


def flow_labels(assigns: DataFrame, seeds: DataFrame, controls: DataFrame | None = None, declassified: DataFrame | None = None, keys=()) -> DataFrame:
    """Label of every variable: join of its sources and of the conditions it is assigned under.

    assigns: keys, src, dst; controls: keys, src (condition variable), dst; seeds: keys, node, level;
    declassified: keys, node, cap. A variable that is read but never assigned or seeded is at the top.
    """
    keys = list(keys)
    flows = assigns.select(*keys, "src", "dst")
    if controls is not None:
        flows = flows.unionByName(controls.select(*keys, "src", "dst"))
    read = flows.select(*keys, F.col("src").alias("node")).distinct()
    bound = flows.select(*keys, F.col("dst").alias("node")).unionByName(seeds.select(*keys, "node")).distinct()
    unknown = read.join(bound, [*keys, "node"], "left_anti").withColumn("level", F.lit(TOP))
    every = seeds.select(*keys, "node", F.col("level").cast("int").alias("level")).unionByName(unknown)
    rest = flows.select(*keys, F.col("dst").alias("node")).distinct().withColumn("level", F.lit(TRUSTED))
    return raise_levels(flows.withColumn("lifts", F.lit(False)), every.unionByName(rest), keys, caps=declassified)


def flow_violations(labels: DataFrame, sinks: DataFrame, keys=()) -> DataFrame:
    """Sinks (keys, node, max_level) whose variable's label is above what they allow; unknown is top."""
    keys = list(keys)
    joined = sinks.join(labels, [*keys, "node"], "left").withColumn("level", F.coalesce("level", F.lit(TOP)))
    return joined.filter(F.col("level") > F.col("max_level"))


# --- control flow -------------------------------------------------------------------------------

#: Predecessors of a node whose dominators are intersected in one group.
PREDECESSORS = 1_000


def dominators(edges: DataFrame, entries: DataFrame, keys, candidates: DataFrame | None = None) -> DataFrame:
    """(keys, node, dom): dom dominates node. Only nodes reached from the entry have dominators.

    The state is one row for each node with its possible dominators, at first the nodes of a shortest path from an entry. A round
    intersects them with those of all predecessors, for the nodes that a change in the last round can touch, until nothing
    changes. Predecessors of a hub meet in groups of bounded size first."""
    keys = list(keys)
    e = _edges(edges, keys)
    start = entries.select(*keys, "node").distinct().select(*keys, "node", F.array("node").alias("path"))

    def step(frontier):
        moved = frontier.join(e, [*keys, "node"]).select(*keys, F.col("_to").alias("node"), F.concat("path", F.array("_to")).alias("path"))
        return moved.groupBy(*keys, "node").agg(F.min("path").alias("path"))

    state = write_cut(grow(start, step, [*keys, "node"]).withColumn("_new", F.lit(True)))
    into = e.join(state.select(*keys, "node"), [*keys, "node"]).where(F.col("node") != F.col("_to"))
    first = start.select(*keys, F.col("node").alias("_to"))
    into = into.join(first, [*keys, "_to"], "left_anti")  # an entry has no dominator but itself
    degree = into.groupBy(*keys, "_to").agg(F.ceil(F.count(F.lit(1)) / PREDECESSORS).alias("_parts"))
    dealt = into.join(degree, [*keys, "_to"]).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts")))
    into = write_cut(dealt.select(*keys, "node", "_to", "_part"))
    common = lambda lists: F.aggregate(lists, F.get(lists, F.lit(0)), F.array_intersect)
    while True:
        seen = Observation()
        touched = state.where("_new").join(into, [*keys, "node"]).select(*keys, "_to").distinct()
        asked = into.join(touched, [*keys, "_to"], "left_semi").join(state.drop("_new"), [*keys, "node"])
        parts = asked.groupBy(*keys, "_to", "_part").agg(common(F.collect_list("path")).alias("path"))
        whole = parts.groupBy(*keys, F.col("_to").alias("node")).agg(common(F.collect_list("path")).alias("_all"))
        less = F.array_union(F.array_intersect("path", "_all"), F.array("node"))
        moved = state.drop("_new").join(whole, [*keys, "node"], "left").withColumn("_now", F.coalesce(less, "path"))
        rows = moved.select(*keys, "node", F.col("_now").alias("path"), (F.size("_now") < F.size("path")).alias("_new"))
        state = write_cut(rows.observe(seen, F.count_if("_new").alias("n")))
        if not seen.get["n"]:
            break
    doms = state.select(*keys, "node", F.explode("path").alias("dom"))
    if candidates is None:
        return doms
    return doms.join(candidates.select(*keys, F.col("node").alias("dom")).distinct(), [*keys, "dom"], "left_semi").select(*keys, "node", "dom")


def immediate_dominators(doms: DataFrame, keys) -> DataFrame:
    """(keys, node, idom): the strict dominator that has the most dominators itself."""
    keys = list(keys)
    depth = doms.groupBy(*keys, F.col("node").alias("dom")).agg(F.count(F.lit(1)).alias("_d"))
    strict = doms.filter(F.col("dom") != F.col("node")).join(depth, [*keys, "dom"])
    return strict.groupBy(*keys, "node").agg(F.max_by("dom", "_d").alias("idom"))


def back_edges(edges: DataFrame, doms: DataFrame, keys) -> DataFrame:
    """Edges whose target dominates their source: (keys, tail, header)."""
    keys = list(keys)
    loops = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("dom")).distinct()
    return loops.join(doms, [*keys, "node", "dom"], "left_semi").select(*keys, F.col("node").alias("tail"), F.col("dom").alias("header"))


def natural_loops(edges: DataFrame, backs: DataFrame, keys) -> DataFrame:
    """Body of each loop: header, tail and all nodes that reach the tail without passing the header."""
    keys = list(keys)
    e = _edges(edges, keys, forward=False)
    ids = [*keys, "tail", "header"]
    start = backs.select(*ids, F.col("tail").alias("node")).unionByName(backs.select(*ids, F.col("header").alias("node")))

    def step(frontier):
        return frontier.filter(F.col("node") != F.col("header")).join(e, [*keys, "node"]).select(*ids, F.col("_to").alias("node"))

    return grow(start, step, [*ids, "node"])


def unguarded(blocks: DataFrame, doms: DataFrame, keys, entry_prefixes=("process_", "handle_", "execute_"), init_parts=("init", "create")) -> DataFrame:
    """Sensitive blocks without a dominating guard.

    blocks: keys (the last one is the function name), node, is_guard, is_sensitive. A function with
    guards gives CFG-01; one without any gives CFG-02 if it is an entry point that initialises nothing.
    """
    keys = list(keys)
    fn = F.col(keys[-1])
    guards = blocks.filter("is_guard").select(*keys, F.col("node").alias("dom"))
    guarded_fn = guards.select(*keys).distinct()
    covered = doms.join(guards, [*keys, "dom"], "left_semi").select(*keys, "node").distinct()
    sensitive = blocks.filter("is_sensitive").select(*keys, "node")
    bypassed = sensitive.join(guarded_fn, keys, "left_semi").join(covered, [*keys, "node"], "left_anti")
    is_entry, is_init = F.lit(False), F.lit(False)
    for p in entry_prefixes:
        is_entry = is_entry | fn.startswith(p)
    for p in init_parts:
        is_init = is_init | F.contains(fn, F.lit(p))
    bare = sensitive.join(guarded_fn, keys, "left_anti").filter(is_entry & ~is_init)
    return bypassed.withColumn("id", F.lit("SOL-CFG-01")).unionByName(bare.withColumn("id", F.lit("SOL-CFG-02")))


# Header tokens of a bounded iteration and body tokens that leave or limit a loop.
BOUNDED_HEADER = ("..", "take(", "chunks(", "windows(")
BOUNDED_BODY = ("break", "return", "MAX_", "limit")


def unbounded_loops(loops: DataFrame, blocks: DataFrame, keys, header=BOUNDED_HEADER, body=BOUNDED_BODY) -> DataFrame:
    """CFG-04: loops (keys, tail, header, node) without a bound in their header or body.
    blocks: keys, node, code."""
    keys = list(keys)
    ids = [*keys, "tail", "header"]
    code = loops.join(blocks.select(*keys, "node", "code"), [*keys, "node"])
    at_header = F.col("node") == F.col("header")
    bounded = (at_header & has_any(F.col("code"), header)) | has_any(F.col("code"), body)
    out = code.groupBy(*ids).agg(F.bool_or(bounded).alias("_ok"), F.count_distinct("node").alias("n_blocks"))
    return out.filter("not _ok").select(*ids, "n_blocks", F.lit("SOL-CFG-04").alias("id"))


# --- data flow ----------------------------------------------------------------------------------

def reaching_definitions(edges: DataFrame, defs: DataFrame, keys) -> DataFrame:
    """(keys, node, var, def_id): definitions that reach the start of each node.

    A definition leaves its node, and passes a node unless that node defines the same variable.
    """
    keys = list(keys)
    e = _edges(edges, keys)
    kills = write_cut(defs.select(*keys, "node", "var").distinct())
    out = defs.select(*keys, "node", "var", "def_id").distinct()

    def move(rows):
        return rows.join(e, [*keys, "node"]).select(*keys, F.col("_to").alias("node"), "var", "def_id")

    return grow(move(out), lambda new: move(new.join(kills, [*keys, "node", "var"], "left_anti")), [*keys, "node", "var", "def_id"])


def live_variables(edges: DataFrame, uses: DataFrame, defs: DataFrame, keys) -> DataFrame:
    """(keys, node, var): variables live at the end of each node (read later before being redefined)."""
    keys = list(keys)
    e = _edges(edges, keys, forward=False)
    kills = write_cut(defs.select(*keys, "node", "var").distinct())
    read = uses.select(*keys, "node", "var").distinct()

    def move(rows):
        return rows.join(e, [*keys, "node"]).select(*keys, F.col("_to").alias("node"), "var")

    return grow(move(read), lambda new: move(new.join(kills, [*keys, "node", "var"], "left_anti")), [*keys, "node", "var"])


def use_def(uses: DataFrame, reaching: DataFrame, keys) -> DataFrame:
    """(use, def) pairs: which definitions each use may read."""
    return uses.join(reaching, [*keys, "node", "var"])


def uninitialized_uses(uses: DataFrame, reaching: DataFrame, keys) -> DataFrame:
    """Uses that no definition reaches."""
    return uses.join(reaching.select(*keys, "node", "var").distinct(), [*keys, "node", "var"], "left_anti")


def dead_definitions(defs: DataFrame, live: DataFrame, keys) -> DataFrame:
    """Definitions whose variable is not live after their node."""
    return defs.join(live, [*keys, "node", "var"], "left_anti")


def dataflow_findings(uninitialized: DataFrame, dead: DataFrame, keys) -> DataFrame:
    """Both data-flow results as findings: (keys, node, var, id, severity, confidence)."""
    cols = [*keys, "node", "var"]
    make = lambda df, rule, severity, confidence: df.select(
        *cols, F.lit(rule).alias("id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))
    return make(uninitialized, "DF-SOL-090", 3, 40).unionByName(make(dead, "DF-SOL-091", 1, 30))


def value_flow(chains: DataFrame, def_id) -> DataFrame:
    """Uses one definition flows to."""
    return chains.filter(F.col("def_id") == def_id)


def liveness_intervals(live: DataFrame, keys) -> DataFrame:
    """First and last node at which each variable is live."""
    return live.groupBy(*keys, "var").agg(F.min("node").alias("first"), F.max("node").alias("last"))


def field_tainted(uses: DataFrame, marks: DataFrame, keys=()) -> DataFrame:
    """Field reads that are tainted: the exact path, the whole object, or any prefix of the path is marked.

    uses: keys, object, path ARRAY<STRING>; marks: keys, object, path (empty: the whole object).
    """
    keys = list(keys)
    prefixes = F.transform(F.sequence(F.lit(0), F.size("path")), lambda i: F.array_join(F.slice("path", 1, i), "."))
    ids = uses.withColumn("_p", F.explode(prefixes))
    m = marks.select(*keys, "object", F.array_join("path", ".").alias("_p")).distinct()
    return ids.join(m, [*keys, "object", "_p"], "left_semi").drop("_p").distinct()
