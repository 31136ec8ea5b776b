import itertools
import random

from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.plans.families import family_findings
from auditlake.operators import code, graph
from auditlake.rules import packs
from auditlake.sources.corpus import extract_structs, extract_units, source_string

TEXT = """#[derive(Accounts)]
pub struct Pay<'info> {
    #[account(mut, has_one = admin, close = receiver)]
    pub vault: Account<'info, Vault>,
    #[account(mut, seeds = [b"x", user.key().as_ref()], bump)]
    pub pda: Account<'info, Vault>,
    #[account(mut)]
    pub other: Box<Account<'info, Vault>>,
    /// CHECK: verified below
    pub receiver: UncheckedAccount<'info>,
    pub admin: AccountInfo<'info>,
    #[account(token::mint = mint, token::authority = admin)]
    pub tokens: Account<'info, TokenAccount>,
    pub signer: Signer<'info>,
}

pub fn process_pay(ctx: Context<Pay>, amount: u64, flag: bool) -> Result<()> {
    let base = 10;
    let total = amount * base;
    let price = get_price(feed);
    let mixed = total + price;
    token::transfer(cpi, mixed)?;
    state.balance += total;
    helper(total, base)?;
    Ok(())
}

fn helper(x: u64, y: u64) -> u64 {
    invoke(&ix, &[x])?;
    return y;
}
"""


def units(spark):
    return extract_units(source_string(spark, TEXT))


def test_account_fields(spark):
    out = {r["name"]: r for r in code.account_fields(extract_structs(source_string(spark, TEXT)), ["struct_name"]).collect()}
    kinds = {n: r["account_type"] for n, r in out.items()}
    assert kinds == {"vault": "TypedAccount", "pda": "TypedAccount", "other": "TypedAccount", "receiver": "UncheckedAccount",
                     "admin": "RawAccountInfo", "tokens": "TokenAccount", "signer": "Signer"}
    assert out["vault"]["type_arg"] == "Vault" and out["vault"]["is_mutable"] and not out["admin"]["is_mutable"]
    assert {c["kind"]: c["arg"] for c in out["vault"]["constraints"]} == {"Mutable": "", "HasOne": "admin", "Close": ""}
    assert out["receiver"]["has_check"] and out["signer"]["is_signer"]


def test_aliasing(spark):
    s = extract_structs(source_string(spark, TEXT))
    pairs = {(r["account_a"], r["account_b"], r["severity"]) for r in code.alias_pairs(s, ["struct_name"]).collect()}
    # vault/admin are linked, pda is derived, wild accounts meet every type, one side must be mutable;
    # `Box<Account<..>>` keeps its own inner text, so vault and other differ only if their types do
    assert ("vault", "admin", 4) not in pairs and not any("pda" in p for p in pairs)
    assert ("vault", "receiver", 4) in pairs and ("other", "admin", 4) in pairs
    found = {(r["field"], r["id"]) for r in code.aliasing_findings(s, ["struct_name"]).collect()}
    assert found == set()


STRUCTS = """#[derive(Accounts)]
pub struct Bad<'info> {
    #[account(mut)]
    pub source: AccountInfo<'info>,
    #[account(mut)]
    pub destination: AccountInfo<'info>,
    #[account(init_if_needed, close = taker)]
    pub state: Account<'info, State>,
    #[account(seeds = [b"fixed"])]
    pub note: Account<'info, Note>,
    pub oracle_program: AccountInfo<'info>,
}
#[derive(Accounts)]
pub struct Good<'info> {
    /// CHECK: owner is compared in the handler
    #[account(owner = crate::ID)]
    pub raw: UncheckedAccount<'info>,
    pub user: Signer<'info>,
}
"""


def test_account_safety_rules(spark):
    s = extract_structs(source_string(spark, STRUCTS))
    found = {(r["struct_name"], r["field"], r["id"]) for r in packs.account_safety(s, ["struct_name"]).collect()}
    want = {
        ("source", "OWNER-01"), ("destination", "OWNER-01"), ("oracle_program", "OWNER-01"), ("oracle_program", "CONFUSION-01"),
        ("state", "CLOSE-01"), ("state", "CLOSE-02"), ("state", "CLOSE-03"), ("state", "ANCHOR-REINIT"), ("state", "ANCHOR-CLOSE"),
        ("state", "PDA-03"), ("state", "ANCHOR-INIT-SEEDS"), ("note", "PDA-01"), ("note", "ANCHOR-BUMP"), ("note", "ANCHOR-SEEDS"),
        ("oracle_program", "ANCHOR-PROGRAM"), ("", "SIGNER-02")}
    assert found == {("Bad", f, i) for f, i in want}
    pairs = packs.duplicate_mutable(s, ["struct_name"]).select("account_a", "account_b").collect()
    assert [tuple(r) for r in pairs] == [("source", "destination")]


#: Heads without a type, types of one blank, nested types, comments and marks, which a cut at the fields must read like a search by pieces.
ODD = """pub struct Odd<'info> {
    pub none:, pub first: AccountInfo<'info>, pub blank:\t, pub two: A<B<C<D>>>,
    // mut
    xpub skipped: Signer<'info>, #[account(mut)] pub  third : Account < 'info , Mint >
    #[account(has_one = first)] pub last: Vec<u8>
}
"""


def made_texts(spark, text):
    """The structs of a text that the plan can't read ahead."""
    return extract_structs(spark.range(1).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("content"), "id"), keep=["id"])


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def compiled(df):
    """The array of a field's tests is made neither twice, by a filter of its size, nor as the argument of a function that interprets it."""
    return "size(" not in planned(df) and "knownnotcontainsnull(" not in planned(df)


def test_fields_of_odd_declarations(spark):
    s = extract_structs(source_string(spark, ODD + ODD.replace("// mut", "// \0")))
    out = [tuple(r) for r in code.account_fields(s, ["struct_no"]).select("struct_no", "pos", "name", "type_text", "is_mutable").collect()]
    want = [(0, "none", ",pubfirst:AccountInfo<'info>", False), (1, "blank", "", False), (2, "two", "A<B<C<D>>>", False), (3, "third", "Account<'info,Mint>", True),
            (4, "last", "Vec<u8>", False)]
    assert sorted(out) == [(i, *w) for i in (0, 1) for w in want]
    whole = code.with_fields(s).select("struct_no", F.inline("fields"))
    assert whole.exceptAll(code.account_fields(s, ["struct_no"])).count() == 0 and whole.count() == 10


def test_aliasing_is_compiled(spark):
    s = made_texts(spark, STRUCTS)
    assert compiled(code.aliasing_findings(s, ["struct_name"]))
    found = {(r["struct_name"], r["field"], r["id"]) for r in code.aliasing_findings(s, ["struct_name"]).collect()}
    assert found == {("Bad", f, "SOL-ALIAS-02") for f in ("source", "destination", "oracle_program")}


def test_account_safety_is_compiled(spark):
    s = made_texts(spark, STRUCTS.replace("pub user: Signer", "#[account(mut)]\n    pub user: Program"))
    out = packs.account_safety(s, ["struct_name"])
    assert compiled(out)
    # a struct's own finding comes once, whatever the number of its fields
    assert sorted(r["struct_name"] for r in out.filter("id = 'SIGNER-02'").collect()) == ["Bad", "Good"]


def test_duplicate_mutable_skips_bodies(spark):
    body = "#[account(mut)]\n    pub source: AccountInfo<'info>,\n    #[account(mut, constraint = {})]\n    pub dest: AccountInfo<'info>,\n"
    texts = [body.format(c) for c in ("dest.key() != source.key()", "x")] + [body.replace("mut", "", 1).format("x")]
    s = made_texts(spark, "".join(f"pub struct S{i}<'info> {{\n{t}}}\n" for i, t in enumerate(texts)))
    out = packs.duplicate_mutable(s, ["struct_name"])
    assert ", mut, 2)" in planned(out)
    assert [tuple(r) for r in out.collect()] == [("S1", "source", "dest")]


def test_alias_counts_match_pairs(spark):
    rng = random.Random(4)
    fields, links = [], []
    for g in range(6):
        n = 60 if g == 0 else rng.randrange(1, 9)
        fields += [(g, i, rng.choice(["any", "a", "b", None]), rng.random() < 0.5, rng.random() < 0.2) for i in range(n)]
        links += [(g, rng.randrange(n), rng.randrange(n)) for _ in range(5)]
    f = spark.createDataFrame(fields, "group int, field int, kind string, is_mutable boolean, is_seeded boolean")
    out = {r["group"]: (r["both_mutable"], r["one_mutable"]) for r in code.alias_counts(f, spark.createDataFrame(links, "group int, a int, b int")).collect()}
    linked = {(g, min(a, b), max(a, b)) for g, a, b in links}
    want = {}
    for g, rows in itertools.groupby(fields, key=lambda r: r[0]):
        rows = [r for r in rows if not r[4]]
        both = one = 0
        for a, b in itertools.combinations(rows, 2):
            meets = a[2] == "any" or b[2] == "any" or (a[2] is not None and a[2] == b[2])
            if meets and (g, a[1], b[1]) not in linked:
                both += a[3] and b[3]
                one += a[3] != b[3]
        if rows:
            want[g] = (both, one)
    assert out == want


def test_effects_after_calls_counts_pairs(spark):
    rng = random.Random(8)
    data = [(rng.choice(["hot", "hot", "f"]), i, rng.random() < 0.2, rng.random() < 0.3) for i in range(200)]
    out = code.effects_after_calls(spark.createDataFrame(data, "fn string, block long, is_call boolean, is_effect boolean"), bucket=F.floor(F.col("block") / 13))
    pairs = sum(1 for a in data for b in data if a[0] == b[0] and a[2] and b[3] and a[1] < b[1])
    assert out.agg(F.sum("n_calls_before")).collect()[0][0] == pairs


def test_taint_chain(spark):
    u = units(spark)
    st = code.unit_statements(u)
    keys = code.UNIT_KEYS
    assigned = code.assignments(st.filter(~F.col("code").rlike(r"^(?:pub )?fn\s")))
    params = code.parameters(u).filter("level is not null").select(*keys, F.col("param").alias("node"), "level")
    fixed = assigned.filter("fixed_level is not null").select(*keys, F.col("lhs").alias("node"), F.col("fixed_level").alias("level"))
    edges = assigned.filter("fixed_level is null").select(*keys, F.explode("rhs_vars").alias("src"), F.col("lhs").alias("dst"), F.col("is_arithmetic").alias("lifts"))
    levels = graph.raise_levels(edges, params.unionByName(fixed), keys).withColumnRenamed("node", "var")
    got = {(r["fn_name"], r["var"]): r["level"] for r in levels.collect()}
    assert got[("process_pay", "ctx")] == 2 and got[("process_pay", "amount")] == 2
    assert got[("process_pay", "total")] == 3 and got[("process_pay", "price")] == 4 and got[("process_pay", "mixed")] == 4
    assert ("process_pay", "flag") not in got
    sinks = {(r["id"], r["var"]) for r in code.tainted_sinks(code.taint_sink_uses(st), levels).collect()}
    assert ("SOL-TAINT-04", "total") in sinks and ("SOL-TAINT-02", "x") in sinks
    inside, outside = code.call_edges(code.call_sites(st), u)
    assert {r["callee"] for r in inside.collect()} == {"helper"}
    assert {"get_price", "transfer", "invoke"} <= {r["callee"] for r in outside.collect()}
    hits = code.apply_summaries(inside, code.fn_summaries(u), levels.select("program", "fn_name", "var", "level"))
    assert [(r["callee"], r["param"], r["level"], r["severity"]) for r in hits.collect()] == [("helper", "x", 3, 4)]
    risky = {(r["callee"], r["id"], r["severity"]) for r in code.dangerous_calls(outside, u).collect()}
    assert ("transfer", "SOL-CPI-transfer", 5) in risky


def test_dangerous_list_first_match(spark):
    calls = spark.createDataFrame([("p", "f", "g", "transfer_checked", "token::transfer_checked", 3), ("p", "f", "g", "peek", "pyth::peek", 4), ("p", "f", "h", "close", "a::close", 5)],
                                  "program string, file_path string, fn_name string, callee string, path string, line_no int")
    u = spark.createDataFrame([("p", "f", "g", "x.is_signer"), ("p", "f", "h", "x.is_signer; checked_add")], "program string, file_path string, fn_name string, code string")
    out = sorted((r["callee"], r["id"], r["severity"], r["confidence"]) for r in code.dangerous_calls(calls, u).collect())
    assert out == [("peek", "SOL-CPI-02", 4, 65), ("transfer_checked", "SOL-CPI-transfer_checked", 5, 70)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("CreatePoolAccounts", "^~1.2", "a/node_modules/@s/p/x.js", "limit 5 then 1_400_000 and 9999999")], "s string, v string, p string, t string")
    r = df.select(tx.instruction_name(F.col("s")), tx.clean_version(F.col("v")), tx.package_from_path(F.col("p")), tx.first_int_over(F.col("t"), 1000)).collect()[0]
    assert tuple(r) == ("create_pool", "1.2", "@s/p", 1400000)


def test_summaries_over_chains_and_recursion(spark):
    """a passes x to b, b to c, c to a sink; d and e call each other and e has the sink; f passes another value."""
    text = "\n".join([
        "fn a(x: AccountInfo, y: u64) {", "    b(y, x);", "}", "fn b(p: u64, q: AccountInfo) {", "    c(q)", "}", "fn c(z: AccountInfo) {", "    invoke(z, ix);", "}",
        "fn d(m: AccountInfo) {", "    e(m);", "}", "fn e(n: AccountInfo) {", "    d(n);", "    token::transfer(n, k);", "}", "fn f(s: u64) {", "    c(other);", "    a(one, s);", "}", ""])
    files = spark.createDataFrame([("p", "x.rs", "x.rs", text)], "program string, file_path string, file_name string, content string")
    units = extract_units(files, keep=["program", "file_path", "file_name"])
    inside, _ = code.call_edges(code.call_sites(code.unit_statements(units)), units)
    got = {(r["fn_name"], r["param"]): r["sink_hops"] for r in code.transitive_summaries(code.fn_summaries(units), inside).collect()}
    assert got == {("a", "x"): 2, ("a", "y"): None, ("b", "p"): None, ("b", "q"): 1, ("c", "z"): 0, ("d", "m"): 1, ("e", "n"): 0, ("f", "s"): None}
    found = {(r["function_name"], r["vuln_type"]) for r in family_findings(files).collect() if r["id"] == "SOL-TAINT-IP-01"}
    assert ("a", "Cross-Function Taint: a to b (param q)") in found and ("d", "Cross-Function Taint: d to e (param n)") in found


def test_small_graphs_rise_like_rounds(spark):
    edges = spark.createDataFrame(
        [("u", "a", "b", True), ("u", "b", "c", False), ("u", "c", "a", True), ("u", "x", "d", True), ("v", "a", "b", None), (None, "a", "z", False), ("w", "b", "c", True)],
        "k string, src string, dst string, lifts boolean")
    seeds = spark.createDataFrame([("u", "a", 2), ("u", "a", 1), ("u", "d", 1), ("v", "a", 5), (None, "a", 4), ("w", "c", 0)], "k string, node string, level int")
    rows = lambda df: sorted(map(str, df.select("k", "node", "level").collect()))
    small = graph.raise_levels(edges, seeds, ["k"], small=True)
    assert rows(small) == rows(graph.raise_levels(edges, seeds, ["k"]))
    assert {(r["k"], r["node"]): r["level"] for r in small.collect()}[("u", "c")] == 3


def test_calls_are_marked_from_one_reading(spark):
    units = spark.createDataFrame([("p", "f"), ("p", "f"), ("q", "g"), (None, "h")], "program string, fn_name string")
    sites = spark.createDataFrame([("p", "f", 1), ("p", "g", 2), ("q", "g", 3), (None, "h", 4)], "program string, callee string, line_no int")
    marked = code.mark_calls(sites, units)
    assert sorted((r["line_no"], r["internal"]) for r in marked.collect()) == [(1, True), (2, False), (3, True), (4, False)]
    inside, outside = code.call_edges(sites, units)
    assert sorted(r["line_no"] for r in inside.collect()) == [1, 3] and sorted(r["line_no"] for r in outside.collect()) == [2, 4]
    assert inside.columns == sites.columns or sorted(inside.columns) == sorted(sites.columns)


def test_statement_without_a_sign_assigns_nothing(spark):
    from auditlake.functions import statements as st

    rows = spark.createDataFrame([("swap(pool, amount, 0);",), ("let x;",), ("let x = y;",), ("a.b += c;",), (None,)], "code string")
    name, rhs = st.assignment(rows["code"])
    got = [tuple(r) for r in rows.select(name.alias("n"), rhs.alias("r")).collect()]
    assert got == [(None, ""), (None, ""), ("x", "y;"), ("b", "c;"), (None, None)]


def test_arithmetic_patterns_need_their_tokens(spark):
    lines = ["a + b", "a - (b)", "x / rate", "x / 100", "x as u64", "1 << n", "n >> k", "n % m", "a.checked_add(b) as u64", "// a + b", "a+b"]
    files = spark.createDataFrame([("f", "\n".join(lines)), ("g", None)], "file_path string, content string")
    found = {(r["line_no"], r["kind"]) for r in packs.scan_arithmetic(files, keep=["file_path"]).collect()}
    assert found == {
        (1, "UncheckedArithmetic"), (2, "UncheckedArithmetic"), (3, "PotentialDivisionByZero"), (4, "PotentialPrecisionLoss"), (5, "IntegerCastingRisk"),
        (6, "ShiftOverflow"), (7, "ShiftOverflow"), (8, "ModuloByZero")}
    plan = packs.scan_arithmetic(files, keep=["file_path"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(line" in plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_calls_carry_the_checks_of_their_function(spark):
    text = "fn a(x: AccountInfo) {\n    token::transfer(x);\n}\nfn b(x: AccountInfo) {\n    require_signed(x);\n    let y = n.checked_add(1);\n    token::transfer(x);\n}\n"
    files = spark.createDataFrame([("p", "x.rs", "x.rs", text), ("p", None, "x.rs", text)], "program string, file_path string, file_name string, content string")
    units = extract_units(files, keep=["program", "file_path", "file_name"])
    keys = [*code.CALL_CHECKS, *code.UNIT_KEYS]
    calls = [code.call_edges(code.call_sites(code.unit_statements(u, k), k), units)[1] for u, k in ((units, code.UNIT_KEYS), (code.with_call_checks(units), keys))]
    joined, carried = (code.dangerous_calls(c, units) for c in calls)
    assert sorted(map(tuple, carried.collect())) == sorted(map(tuple, joined.collect())) and {r["fn_name"] for r in carried.collect()} == {"a"}
    assert _plan(carried).count("Join ") == 1 < _plan(joined).count("Join ")


def test_summaries_by_function_and_carried_parameters(spark):
    text = "fn a(x: AccountInfo, y: u64) {\n    b(y, x);\n}\nfn b(p: u64, q: AccountInfo) {\n    invoke(q, ix);\n}\n"
    files = spark.createDataFrame([("p", "x.rs", "x.rs", text), ("q", "y.rs", "y.rs", text), ("q", None, None, text)], "program string, file_path string, file_name string, content string")
    units = extract_units(files, keep=["program", "file_path", "file_name"])
    held = ["params", *code.UNIT_KEYS]
    inside, _ = code.call_edges(code.call_sites(code.unit_statements(code.with_parameters(units), held), held), units)
    known = code.fn_summaries(units).groupBy("program", "fn_name", "pos").agg(F.bool_or("reaches_sink").alias("reaches_sink"))
    got = sorted((r["program"], r["fn_name"], r["pos"], r["sink_hops"]) for r in code.transitive_summaries(known, inside).where("reaches_sink").collect())
    assert got == [(p, f, n, h) for p in "pq" for f, n, h in (("a", 0, 1), ("b", 1, 0))]


def test_units_and_summaries_read_a_text_once(spark):
    files = spark.createDataFrame([("p", "x.rs", "x.rs", "fn a(x: u64) {\n    invoke(x)\n}\n")], "program string, file_path string, file_name string, content string")
    units = extract_units(files.repartition(2).withColumn("content", F.concat("content", "content")), keep=["program"])
    assert _plan(units.select("program", "fn_name", "code")).count("split(") == 1
    assert _plan(units.select("program", "fn_name", "code")).count("regexp_extract(") == 1
    one = code.fn_summaries(units, ["program", "fn_name"])
    assert {(r["fn_name"], r["reaches_sink"], r["returns"]) for r in one.collect()} == {("a", True, False)} and _plan(one).count("size(split(") == 0


def test_line_of_a_syscall_is_counted_without_a_pattern(spark):
    df = spark.createDataFrame([("a\nb\nmsg!(x); msg!(y)",), ("msg!",), (None,)], "content string")
    out = packs.syscall_usage(df, keep=["content"])
    assert sorted((r["syscall"], r["line_no"]) for r in out.collect()) == [("sol_log", 1), ("sol_log", 3)]
    assert "regexp_replace" not in _plan(out)


def test_call_edges_query_runs_the_operator_on_whole_calls(spark, tmp_path, monkeypatch):
    """Every call reaches code.call_edges with its caller, arguments and line, and both sides are counted."""
    from auditlake.catalog import load

    li = [(k, 1 + k % 3, 10 + k, 1 + k % 2, float(k)) for k in range(1, 41)] + [(7, 1, 11, None, 3.0), (None, 2, 12, 1, 4.0)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"
    spark.createDataFrame(li, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen, plain = [], code.call_edges

    def spied(sites, units, by="program"):
        seen.append((sites, *plain(sites, units, by)))
        return seen[-1][1:]

    monkeypatch.setattr(code, "call_edges", spied)
    got = load()[0]["call_edges"](spark, str(tmp_path)).collect()
    (sites, inside, outside), = seen
    for side in (inside, outside):
        assert {"caller", "callee", "path", "args", "line_no", "file_path"} <= set(side.columns)
    assert sum(r["n"] for r in got if r["internal"]) == inside.count() > 0
    assert sum(r["n"] for r in got if not r["internal"]) == outside.count() > 0
    assert sum(r["n"] for r in got) == sites.count()


def test_levels_from_one_reading_of_the_statements(spark):
    """Statements that carry their function's parameters give the levels that written assignments and parameters give."""
    from auditlake.plans import families

    text = ("fn f(x: u64, y: AccountInfo) {\n let a = x;\n let b = a + y;\n}\nfn f(z: Pubkey) {\n let c = b;\n b = z;\n}\nfn empty() {}\n"
            "pub(crate) fn g(q: bool) -> u64 { let w = q; }\n")
    rows = [("p", "a.rs", text), ("p", "a.rs", "fn f(k: i64) {\n c = k;\n}\n"), ("p", None, "fn f(m: u64) {\n let a = m;\n let t = oracle;\n}\n"),
            (None, "b.rs", "pub fn h(v: u128) {\n let d = v;\n let e = 5\n}\n"), ("q", "c.rs", None)]
    units = extract_units(spark.createDataFrame(rows, "program string, file_path string, content string"), keep=["program", "file_path"])
    keys = code.UNIT_KEYS
    carried = code.unit_statements(code.with_parameter_levels(units), ["seeds", *keys])
    once, written = families.unit_levels(units, carried, keys), families.unit_levels(units, code.unit_statements(units), keys)
    shown = lambda df: sorted(map(str, df.select(*keys, "var", "level").collect()))
    assert shown(once) == shown(written) and once.count() == 10
