"""Graph fixpoints against plain Python on small random graphs."""

import random

import pytest
from auditlake.operators import graph
from auditlake.operators.temporal import Transitions


def reach(edges, start, removed=None):
    seen, todo = set(), [s for s in start if s != removed]
    while todo:
        n = todo.pop()
        if n in seen:
            continue
        seen.add(n)
        todo += [b for a, b in edges if a == n and b != removed]
    return seen


def random_graphs(seed, n_graphs=4, nodes=7, p=0.22):
    rng = random.Random(seed)
    return {g: sorted({(a, b) for a in range(nodes) for b in range(nodes) if a != b and rng.random() < p}) for g in range(n_graphs)}


def frame(spark, graphs):
    return spark.createDataFrame([(g, a, b) for g, es in graphs.items() for a, b in es], "g int, src int, dst int")


@pytest.mark.parametrize("seed", [1, 2])
def test_dominators_loops(spark, seed):
    graphs = random_graphs(seed)
    edges = frame(spark, graphs)
    entries = spark.createDataFrame([(g, 0) for g in graphs], "g int, node int")
    doms = graph.dominators(edges, entries, ["g"])
    got = {(r["g"], r["node"], r["dom"]) for r in doms.collect()}
    want = set()
    for g, es in graphs.items():
        base = reach(es, [0])
        for d in base:
            left = reach(es, [0], removed=d)
            want |= {(g, n, d) for n in base if n not in left}
    assert got == want
    idom = {(r["g"], r["node"]): r["idom"] for r in graph.immediate_dominators(doms, ["g"]).collect()}
    size = lambda g, n: sum(1 for x in want if x[0] == g and x[1] == n)
    for (g, n), d in idom.items():
        strict = [x[2] for x in want if x[0] == g and x[1] == n and x[2] != n]
        assert d == max(strict, key=lambda x: size(g, x))
    backs = graph.back_edges(edges, doms, ["g"])
    pairs = {(r["g"], r["tail"], r["header"]) for r in backs.collect()}
    assert pairs == {(g, a, b) for g, es in graphs.items() for a, b in es if (g, a, b) in want}
    loops = {}
    for r in graph.natural_loops(edges, backs, ["g"]).collect():
        loops.setdefault((r["g"], r["tail"], r["header"]), set()).add(r["node"])
    for (g, t, h), body in loops.items():
        back = [(b, a) for a, b in graphs[g]]
        assert body == reach([(a, b) for a, b in back if a != h], [t]) | {h}
    some = spark.createDataFrame([(g, 1) for g in graphs], "g int, node int")
    only = {(r["g"], r["node"], r["dom"]) for r in graph.dominators(edges, entries, ["g"], some).collect()}
    assert only == {x for x in want if x[2] == 1}


def test_dominators_of_hubs_and_whole_graphs(spark, monkeypatch):
    """Without keys, with two entries, with a hub whose predecessors meet in several groups."""
    monkeypatch.setattr(graph, "PREDECESSORS", 3)
    rng = random.Random(4)
    pairs = {(0, k) for k in range(1, 30)} | {(k, 30) for k in range(1, 30)} | {(30, 31), (31, 32), (32, 30), (32, 33), (40, 41), (50, 33)}
    pairs |= {(rng.randrange(1, 30), rng.randrange(1, 30)) for _ in range(20)}
    edges = spark.createDataFrame(sorted(pairs), "src int, dst int")
    nodes = {n for pair in pairs for n in pair}
    for starts in ((0,), (0, 31)):
        live = reach(pairs, starts)
        want = {(n, d) for n in live for d in live if n == d or n not in reach(pairs, starts, d)}
        got = graph.dominators(edges, spark.createDataFrame([(s,) for s in starts], "node int"), [])
        assert {(r["node"], r["dom"]) for r in got.collect()} == want and nodes - live
    some = graph.dominators(edges, spark.createDataFrame([(0,)], "node int"), [], spark.createDataFrame([(30,), (41,)], "node int"))
    assert {(r["node"], r["dom"]) for r in some.collect()} == {(n, 30) for n in (30, 31, 32, 33)}


def test_labels_paths_and_guards(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "b"), ("c", "s"), ("s", "t")], "src string, dst string")
    sources = spark.createDataFrame([("a", "InstructionData")], "node string, label string")
    clean = spark.createDataFrame([("s",)], "node string")
    out = {r["node"]: r["path"] for r in graph.propagate_labels(edges, sources, clean).collect()}
    assert out == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "c", "d"]}
    sinks = spark.createDataFrame([("d", "TokenTransfer"), ("c", "ValidationBypass"), ("t", "StateWrite")], "node string, sink_kind string")
    labels = graph.propagate_labels(edges, sources)
    got = {(r["node"], r["severity"]) for r in graph.taint_flows(labels, sinks).collect()}
    assert got == {("d", "Critical"), ("c", "High"), ("t", "High")}
    back = graph.backward_flows(edges, sinks.filter("node = 't'"), sources).collect()
    assert [r["path"] for r in back] == [["a", "c", "s", "t"]]
    free = graph.reachable_avoiding(edges, sources.select("node"), spark.createDataFrame([("c",)], "node string"))
    assert {r["node"] for r in free.collect()} == {"a", "b"}
    pairs = spark.createDataFrame([("a", "t"), ("t", "a")], "src string, dst string")
    assert {(r["src"], r["connected"]) for r in graph.has_path(edges, pairs).collect()} == {("a", True), ("t", False)}


def test_rounds_of_labels_carry_places_instead_of_paths(spark, monkeypatch):
    seen, real = [], graph.grow

    def watch(start, step, *rest, **named):
        def noted(rows):
            out = step(rows)
            seen.append(out.columns)
            return out
        return real(start, noted, *rest, **named)

    monkeypatch.setattr(graph, "grow", watch)
    pairs = {(f"n{k * k % 23}", f"n{(k * 7 + 3) % 23}") for k in range(60)} | {(f"n{k}", f"n{(k * 5 + 1) % 23}") for k in range(23)}
    sources = [("n1", "A"), ("n2", "B"), ("n4", "A")]
    want = front = {key: (key[0],) for key in sources}
    while front:
        new = {}
        for (node, label), path in front.items():
            for to in (b for a, b in pairs if a == node and (b, label) not in want):
                new[to, label] = min(new.get((to, label), ("~",)), (*path, to))
        want, front = want | new, new
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    got = graph.propagate_labels(edges, spark.createDataFrame(sources, "node string, label string")).collect()
    assert {(r["node"], r["label"]): tuple(r["path"]) for r in got} == want and len(got) == len(want) and max(map(len, want.values())) > 3
    back = graph.backward_flows(edges, spark.createDataFrame([("n1",)], "node string"), spark.createDataFrame([("n2",)], "node string"))
    assert back.count() == 1
    assert seen and not any("path" in columns for columns in seen)


def test_labels_reach_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(104)], "src string, dst string")
    sources = spark.createDataFrame([("n0", "x")], "node string, label string")
    assert graph.propagate_labels(edges, sources).filter("node = 'n104'").count() == 1
    with pytest.raises(RuntimeError, match="not finished after 3 rounds"):
        graph.propagate_labels(edges, sources, max_rounds=3)


def test_context_strings_are_cut(spark):
    edges = spark.createDataFrame([("a", "b", "s1"), ("b", "c", "s2"), ("c", "a", "s3"), ("c", "d", None)], "src string, dst string, site string")
    src = spark.createDataFrame([("a", "L")], "node string, label string")
    out = {(r["node"], tuple(r["context"])) for r in graph.propagate_in_context(edges, src, 2).collect()}
    assert ("d", ("s1", "s2")) in out and all(len(c) <= 2 for _, c in out) and ("a", ("s2", "s3")) in out


def test_conditions_are_collected(spark):
    edges = spark.createDataFrame([("a", "b", "x > 0"), ("b", "c", None), ("a", "c", "y")], "src string, dst string, cond string")
    src = spark.createDataFrame([("a", "L")], "node string, label string")
    out = {(r["node"], r["condition"]) for r in graph.propagate_with_conditions(edges, src).collect()}
    assert out == {("a", ""), ("b", ""), ("b", "x > 0"), ("c", ""), ("c", "x > 0"), ("c", "y")}


def test_dataflow_chain(spark):
    """x = 10; y = x + 1; use y; use z"""
    edges = spark.createDataFrame([("f", 1, 2), ("f", 2, 3), ("f", 3, 4)], "fn string, src int, dst int")
    defs = spark.createDataFrame([("f", 1, "x", 1), ("f", 2, "y", 2), ("f", 3, "dead", 3), ("f", 4, "x", 4)], "fn string, node int, var string, def_id int")
    uses = spark.createDataFrame([("f", 2, "x", 1), ("f", 3, "y", 2), ("f", 4, "z", 3)], "fn string, node int, var string, use_id int")
    reaching = graph.reaching_definitions(edges, defs, ["fn"])
    assert {(r["node"], r["var"], r["def_id"]) for r in reaching.collect()} == {
        (2, "x", 1), (3, "x", 1), (4, "x", 1), (3, "y", 2), (4, "y", 2), (4, "dead", 3)}
    chains = graph.use_def(uses, reaching, ["fn"])
    assert {(r["use_id"], r["def_id"]) for r in chains.collect()} == {(1, 1), (2, 2)}
    assert [r["use_id"] for r in graph.value_flow(chains, 1).collect()] == [1]
    assert [r["var"] for r in graph.uninitialized_uses(uses, reaching, ["fn"]).collect()] == ["z"]
    live = graph.live_variables(edges, uses, defs, ["fn"])
    assert {(r["node"], r["var"]) for r in live.collect()} == {(1, "x"), (2, "y"), (1, "z"), (2, "z"), (3, "z")}
    assert {r["def_id"] for r in graph.dead_definitions(defs, live, ["fn"]).collect()} == {3, 4}
    assert {(r["var"], r["first"], r["last"]) for r in graph.liveness_intervals(live, ["fn"]).collect()} == {("x", 1, 1), ("y", 2, 2), ("z", 1, 3)}


def test_unguarded_blocks(spark):
    edges = spark.createDataFrame([("process_a", 0, 1), ("process_a", 0, 2), ("process_a", 1, 3), ("process_a", 2, 3), ("handle_b", 0, 1), ("process_init", 0, 1), ("other", 0, 1)], "fn string, src int, dst int")
    entries = spark.createDataFrame([(f, 0) for f in ("process_a", "handle_b", "process_init", "other")], "fn string, node int")
    doms = graph.dominators(edges, entries, ["fn"])
    blocks = spark.createDataFrame(
        [("process_a", 1, True, False), ("process_a", 3, False, True), ("handle_b", 1, False, True), ("process_init", 1, False, True), ("other", 1, False, True)],
        "fn string, node int, is_guard boolean, is_sensitive boolean")
    got = {(r["fn"], r["node"], r["id"]) for r in graph.unguarded(blocks, doms, ["fn"]).collect()}
    assert got == {("process_a", 3, "SOL-CFG-01"), ("handle_b", 1, "SOL-CFG-02")}


def test_flow_labels_with_control_context(spark):
    assigns = spark.createDataFrame([("u", "a"), ("a", "b"), ("ghost", "g")], "src string, dst string")
    controls = spark.createDataFrame([("u", "flagged")], "src string, dst string")
    seeds = spark.createDataFrame([("u", 3)], "node string, level int")
    caps = spark.createDataFrame([("b", 1)], "node string, cap int")
    labels = graph.flow_labels(assigns, seeds, controls, caps)
    assert {r["node"]: r["level"] for r in labels.collect()} == {"u": 3, "a": 3, "b": 1, "flagged": 3, "ghost": 4, "g": 4}
    sinks = spark.createDataFrame([("b", 1), ("a", 1), ("never", 2)], "node string, max_level int")
    assert {(r["node"], r["level"]) for r in graph.flow_violations(labels, sinks).collect()} == {("a", 3), ("never", 4)}


def test_field_prefixes(spark):
    uses = spark.createDataFrame([(1, "o", ["a", "b"]), (2, "o", ["c"]), (3, "p", ["x", "y"]), (4, "q", ["ab"])], "id int, object string, path array<string>")
    marks = spark.createDataFrame([("o", ["a"]), ("p", []), ("q", ["a"])], "object string, path array<string>")
    assert {r["id"] for r in graph.field_tainted(uses, marks).collect()} == {1, 3}


# --- temporal properties --------------------------------------------------------------------------

def sat(states, edges, f):
    nxt = {s: {b for a, b in edges if a == s} for s in states}
    kind, *args = f
    if kind == "prop":
        return {s for s, (labels, _) in states.items() if args[0] in labels}
    if kind == "ge":
        return {s for s, (_, b) in states.items() if b.get(args[0], -1) >= args[1]}
    if kind == "zero":
        return {s for s, (_, b) in states.items() if b.get(args[0]) == 0}
    sets = [sat(states, edges, a) for a in args]
    ex = lambda z: {s for s in states if nxt[s] & z}
    ax = lambda z: {s for s in states if nxt[s] <= z}

    def fix(start, step):
        z = start
        while True:
            new = step(z)
            if new == z:
                return z
            z = new

    everything = set(states)
    return {
        "not": lambda: everything - sets[0], "and": lambda: sets[0] & sets[1], "or": lambda: sets[0] | sets[1],
        "EX": lambda: ex(sets[0]), "AX": lambda: ax(sets[0]), "EF": lambda: fix(set(), lambda z: sets[0] | ex(z)),
        "AF": lambda: fix(set(), lambda z: sets[0] | ax(z)), "EG": lambda: fix(everything, lambda z: sets[0] & ex(z)),
        "AG": lambda: fix(everything, lambda z: sets[0] & ax(z)), "EU": lambda: fix(set(), lambda z: sets[1] | (sets[0] & ex(z))),
        "AU": lambda: fix(set(), lambda z: sets[1] | (sets[0] & ax(z))),
    }[kind]()


FORMULAS = [("EX", ("prop", "p")), ("AX", ("prop", "p")), ("EF", ("prop", "q")), ("AF", ("prop", "p")), ("EG", ("not", ("prop", "q"))), ("AG", ("or", ("prop", "p"), ("ge", "v", 100))),
            ("EU", ("prop", "p"), ("prop", "q")), ("AU", ("ge", "v", 100), ("prop", "q")), ("and", ("zero", "v"), ("EF", ("prop", "p")))]


def test_temporal_operators(spark):
    rng = random.Random(11)
    graphs = random_graphs(7, 3, 6, 0.25)
    states = {g: {s: ({x for x in "pq" if rng.random() < 0.5}, {"v": rng.choice([0, 50, 100, 200])}) for s in range(6)} for g in graphs}
    df = spark.createDataFrame([(g, s, sorted(labels), bal, s == 0) for g, ss in states.items() for s, (labels, bal) in ss.items()],
                               "g int, state int, labels array<string>, balances map<string,bigint>, initial boolean")
    system = Transitions(df, frame(spark, graphs), ["g"])
    for f in FORMULAS:
        want = {(g, s) for g in graphs for s in sat(states[g], graphs[g], f)}
        assert {(r["g"], r["state"]) for r in system.satisfying(f).collect()} == want, f
    report = {r["g"]: r["holds"] for r in system.check(FORMULAS[2]).collect()}
    assert report == {g: 0 in sat(states[g], graphs[g], FORMULAS[2]) for g in graphs}
