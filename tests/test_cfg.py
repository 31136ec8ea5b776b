"""Blocks, edges and findings of functions against plain Python and the general graph operators."""

import random
import re

import pytest
from auditlake.operators import cfg, graph
from auditlake.plans.families import family_findings

BODIES = {
    "sequential": ("pub fn process() {\n    let a = 1;\n    let b = 2;\n    let c = 3;\n}\n", [(1, "let a = 1;"), (2, "let b = 2;"), (3, "let c = 3;")]),
    "nested": ("fn f(x: [u8; 4]) -> R {\n  if a { b; c; }\n  else { d; }\n  emit!(Moved { amount });\n\n  for i in v { x += i; }\n  Ok(())\n}\nstruct S { a: u8 }",
               [(1, "if a { b; c; }\n  else { d; }"), (3, "emit!(Moved { amount });"), (5, "for i in v { x += i; }"), (6, "Ok(())")]),
    "one line": ("fn g() { return Err(X); }", [(0, "return Err(X);")]),
    "empty": ("fn h() {}", []),
    "no body": ("fn i();", []),
    "cut": ("fn j() { let a = 1; let b", [(0, "let a = 1;")]),
}


def test_statements_of_bodies(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in BODIES.items()], "name string, code string")
    got = {r["name"]: [(s["line"], s["code"]) for s in r["s"]] for r in rows.select("name", cfg.statements(rows["code"]).alias("s")).collect()}
    assert got == {k: v[1] for k, v in BODIES.items()}


STATEMENTS = {
    "auth": "require!(ctx.accounts.authority.is_signer);", "cpi": "invoke(&ix, &accounts)?;", "transfer": "token::transfer(ctx, amount)?;", "mutation": "vault.balance -= amount;",
    "error": "return Err(Bad);", "branch": "if paused { halt(); }", "loop": "while more { spin(); }", "normal": "log(x);",
}


def functions(seed, n=60):
    rng = random.Random(seed)
    names = ["process_it", "handle_create", "helper", "execute_all"]
    out = []
    for k in range(n):
        lines = [rng.choice([*STATEMENTS.values(), "let a = 1;", "b = a;", "let b: u8 = q(a, c);", "let c = b;", "if a > b { c; }", "for a in b.iter() { go(); }", "a = a.max(b);"]) for _ in range(rng.randint(0, 8))]
        out.append((k, rng.choice(names), "pub fn f(p: u8) {\n" + "".join(f"    {x}\n" for x in lines) + "}\n"))
    return out


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(functions(3), "unit int, fn_name string, code string").cache()


def test_findings_equal_the_graph_operators(spark, units):
    keys = ["unit", "fn_name"]
    blocks = cfg.cfg_blocks(units, keys).cache()
    assert {r["kind"] for r in blocks.collect()} >= set(STATEMENTS)
    edges = cfg.cfg_edges(blocks, keys).cache()
    entries = blocks.where("node = 0").select(*keys, "node")
    doms = graph.dominators(edges, entries, keys)
    marked = blocks.selectExpr(*keys, "node", "kind = 'auth' AS is_guard", "kind IN ('cpi', 'transfer') AS is_sensitive")
    # a block that nothing reaches has no dominator and no finding in the one-pass form
    seen = {tuple(r) for r in graph.reachable(edges, entries, keys).select("unit", "node").collect()}
    want = {(r["unit"], r["node"], r["id"]) for r in graph.unguarded(marked, doms, keys).collect() if (r["unit"], r["node"]) in seen or r["id"] == "SOL-CFG-02"}
    found = cfg.cfg_findings(units, keys).collect()
    assert {(r["unit"], r["node"], r["id"]) for r in found if r["id"] in ("SOL-CFG-01", "SOL-CFG-02")} == want and want
    kinds = {}
    for r in blocks.collect():
        kinds.setdefault(r["unit"], {})[r["node"]] = r["kind"]
    after = {(u, n, sum(k[m] == "cpi" for m in range(n))) for u, k in kinds.items() for n in k if k[n] == "mutation"}
    assert {(r["unit"], r["node"], r["n"]) for r in found if r["id"] == "SOL-CFG-03"} == {x for x in after if x[2]}
    loops = graph.natural_loops(edges, graph.back_edges(edges, doms, keys), keys)
    free = {(r["unit"], r["header"]) for r in graph.unbounded_loops(loops, blocks, keys).collect()}
    assert {(r["unit"], r["node"]) for r in found if r["id"] == "SOL-CFG-04" and (r["unit"], r["node"]) in seen} == free and free


def test_dataflow_equals_the_graph_operators(spark, units):
    keys = ["unit"]
    blocks = cfg.cfg_blocks(units, keys).cache()
    edges = cfg.cfg_edges(blocks, keys).cache()
    named = cfg.cfg_variables(units, keys).cache()
    defs = named.where("sets").selectExpr("unit", "node", "var", "node AS def_id")
    uses = named.where("NOT sets").select("unit", "node", "var")
    bare = graph.uninitialized_uses(uses, graph.reaching_definitions(edges, defs, keys), keys)
    dead = graph.dead_definitions(defs, graph.live_variables(edges, uses, defs, keys), keys)
    want = {(r["unit"], r["node"], r["var"], "DF-SOL-090") for r in bare.collect()} | {(r["unit"], r["node"], r["var"], "DF-SOL-091") for r in dead.collect()}
    got = [(r["unit"], r["node"], r["var"], r["id"]) for r in cfg.cfg_dataflow(units, keys).collect()]
    assert set(got) == want and len(got) == len(want) and {x[3] for x in got} == {"DF-SOL-090", "DF-SOL-091"}


def test_variables_of_statements(spark):
    code = "fn f(p: u8) {\n let a: u64 = p.x + q(b);\n a = a + 1;\n p = 2;\n b == a;\n self.a = c;\n}\n"
    rows = cfg.cfg_variables(spark.createDataFrame([(1, code)], "unit int, code string"), ["unit"]).collect()
    # p is a parameter, b and c are never set, and the field is no variable
    assert sorted((r["node"], r["var"], r["sets"]) for r in rows) == [(0, "a", True), (1, "a", False), (1, "a", True), (3, "a", False)]


def test_samples_of_the_rules(spark):
    bodies = {
        "bad_withdraw": "invoke(&transfer_ix, &accounts);\nvault.balance -= amount;", "process_pay": "invoke(&ix, &accounts);",
        "withdraw": "let x = amount;\nrequire!(ctx.accounts.authority.is_signer);\nanchor_spl::token::transfer(ctx, x);",
        "bypass": "if fast { go(); }\nrequire!(ctx.accounts.authority.is_signer);\ntoken::transfer(ctx, x);", "spin": "while more { go(); }", "some": "for i in 0..10 { go(); }",
    }
    units = spark.createDataFrame([(n, f"fn {n}() {{\n{b}\n}}") for n, b in bodies.items()], "fn_name string, code string")
    got = {r["fn_name"]: re.sub("SOL-", "", r["id"]) for r in cfg.cfg_findings(units, ["fn_name"]).collect()}
    assert got == {"bad_withdraw": "CFG-03", "process_pay": "CFG-02", "bypass": "CFG-01", "spin": "CFG-04"}


def test_flow_findings_are_part_of_the_scan(spark):
    text = "pub fn process_pay(amount: u64) {\n    invoke(&ix, &accounts)?;\n    vault.balance -= amount;\n    while more { go(); }\n    total = fee;\n    let fee = 1;\n}\n"
    files = spark.createDataFrame([("p", "src/a.rs", "a.rs", text)], "program string, file_path string, file_name string, content string")
    found = {(r["id"], r["line_number"], r["vulnerable_code"]) for r in family_findings(files).collect() if r["seq"]["family"] > 8}
    assert found == {("SOL-CFG-02", 2, "invoke(&ix, &accounts)?;"), ("SOL-CFG-03", 3, "vault.balance -= amount;"), ("SOL-CFG-04", 4, "while more { go(); }"), ("SOL-090", 5, "fee"), ("SOL-091", 5, "total")}


def test_dataflow_stays_in_the_row(spark):
    text = "fn f(a: u64) {\n    let x = 1;\n    y = x + a;\n    z = y;\n}\n"
    units = spark.createDataFrame([("k", text), (None, text)], "k string, code string")
    out = cfg.cfg_dataflow(units, ["k"])
    assert "Exchange" not in out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["k"], r["var"], r["node"], r["id"]) for r in out.collect()) == [("k", "z", 2, "DF-SOL-091")]


def test_statements_of_long_tails_and_odd_blanks(spark):
    texts = ["fn f() {\n  a = 1; \u0085 b;\n}\n" + "x" * 200_000, "fn g() { if a { b; } else { c; } d; }", "} fn h() { a; }", "fn i() { a;", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, code string")
    got = {r["i"]: r["s"] and [(s["line"], s["code"]) for s in r["s"]] for r in rows.select("i", cfg.statements(rows["code"]).alias("s")).collect()}
    assert got == {0: [(1, "a = 1;"), (1, "\u0085 b;")], 1: [(0, "if a { b; } else { c; }"), (0, "d;")], 2: [], 3: [(0, "a;")], 4: [], 5: None}


def test_repeated_files_go_before_their_texts_are_made(spark, tmp_path):
    from auditlake.catalog import corpus

    rows = [(1, 1, 3, 5, 10.0), (1, 1, 3, 5, 10.0), (4, 2, 7, 5, 3.0), (None, 1, 3, 5, 10.0), (None, 2, 3, 5, 10.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    files = corpus.distinct_files(spark, str(tmp_path))
    plan = files._jdf.queryExecution().sparkPlan().toString()
    assert "use anchor_lang" in plan.split("Aggregate")[0] and "use anchor_lang" not in "".join(plan.split("Aggregate")[1:])
    plain = corpus.code_files(spark, str(tmp_path))
    named = lambda df: sorted((r["file_path"], r["content"]) for r in df.where("file_path is not null").collect())
    assert named(files) == sorted(set(named(plain))) and len(named(files)) == 2
    assert files.where("file_path is null").count() == 1
    texts = corpus.distinct_texts(spark, str(tmp_path))
    assert named(texts) == named(files) and texts.where("file_path is null").count() == 2
