"""Rule engine against a plain Python reader of the same trees, and detector cases on small snippets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from auditlake.plans.scan import ALL_RULES, all_findings, raw_findings, scan_report, validated_findings
from auditlake.rules import packs
from auditlake.rules.core_pack import CORE
from auditlake.rules.engine import at_least, condition_sql, count, every, line, none, regex, rule, rule_hits, scan_rules, some, tokens_of
from auditlake.rules.structure_pack import STRUCTURE
from auditlake.sources.corpus import extract_units, source_string, units_with_context


def holds(tree, text, row):
    if isinstance(tree, str):
        return tree in text
    kind, *parts = tree
    if kind == "every":
        return all(holds(p, text, row) for p in parts)
    if kind == "some":
        return any(holds(p, text, row) for p in parts)
    if kind == "none":
        return not any(holds(p, text, row) for p in parts)
    if kind == "count":
        return text.count(parts[0]) >= parts[1]
    if kind == "at_least":
        return sum(holds(p, text, row) for p in parts[1:]) >= parts[0]
    if kind == "regex":
        return re.search(parts[0], text) is not None
    if kind == "line":
        return any(holds(parts[0], x, row) for x in text.split("\n"))
    if kind == "lower":
        return holds(parts[0], text.lower(), row)
    if kind == "within":
        return holds(parts[1], row[parts[0]], row)
    if kind == "flag":
        return bool(row[parts[0]])
    raise ValueError(kind)


def random_texts(rules, n, seed):
    rng = random.Random(seed)
    tokens = sorted({t for r in rules for t in tokens_of(r["when"])}) + ["\n", " ", "\n    ", "x", "fn f(a: u64)", " / ", " * ", "é", "'"]
    return ["".join(rng.choice(tokens) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("rules", [CORE, STRUCTURE, packs.DEFI, packs.BINARY_RISKS, packs.CALL_RISKS, packs.HOOK_RULES, packs.COMPATIBILITY],
                         ids=["core", "structure", "defi", "binary", "calls", "hooks", "compat"])
def test_engine_matches_plain_reader(spark, rules):
    texts = random_texts(rules, 150, 5)
    data = [(i, random.Random(i).choice(["swap", "deposit", "other"]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "n int, fn_name string, code string")
    got = {}
    for r in scan_rules(df, rules, "code", ["n"]).collect():
        got.setdefault(r["n"], []).append(r["rule_pos"])
    for n, fn, text in data:
        want = [i for i, r in enumerate(rules) if holds(r["when"], text, {"fn_name": fn})]
        assert sorted(got.get(n, [])) == want, (n, text)


def test_one_pass_and_plain_lookup_agree(spark, monkeypatch, rows):
    from auditlake.rules import engine

    df = spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(CORE, 80, 9))], "n int, code string")
    fast = rows(rule_hits(df, CORE, "code", ["n"]))
    monkeypatch.setattr(engine, "with_token_test", lambda df, trees, text: (df, None))
    assert rows(rule_hits(df, CORE, "code", ["n"])) == fast


def test_rules_of_tokens_are_decided_beside_the_marks(spark):
    """Packs with many tokens leave the JVM only the rules with patterns or lines, and a null text is empty."""
    tokens = [f"tok{i:03d}!" for i in range(70)]
    own = [rule(f"T-{i}", "t", 1, some(t, every("é", count(t[:3], 2)))) for i, t in enumerate(tokens)]
    own.append(rule("R", "r", 2, every(tokens[0], none(tokens[1], regex("x+y")), line(every(tokens[0], regex("z$"))))))
    own.append(rule("N", "n", 3, every(none(tokens[2]), at_least(1, tokens[3], regex("^q")))))
    texts = [None, "", "tok000! z", "tok000! xy z", "é tok tok", "\0tok003!\0tok069!", "q", "q tok002!", "tok000!\ntok001! z", "tok00", "1!"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, code string")
    got = sorted((r["n"], r["rule_pos"]) for r in scan_rules(df, own, "code", ["n"]).collect())
    flat = lambda i, t: [k for k, r in enumerate(own) if holds(r["when"], t or "", {})]
    assert got == sorted((i, k) for i, t in enumerate(texts) for k in flat(i, t))
    plan = scan_rules(df, own, "code", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 10  # one for each rule of the pack before


def test_rule_table_is_complete():
    ids = [r["id"] for r in [*CORE, *STRUCTURE]]
    assert len(ids) == 92 and len(set(ids)) == 91
    assert all(1 <= r["severity"] <= 5 and r["name"] for r in ALL_RULES)


VULNERABLE = """use anchor_lang::prelude::*;

#[derive(Accounts)]
pub struct Withdraw<'info> {
    #[account(mut)]
    pub vault: AccountInfo<'info>,
    pub authority: AccountInfo<'info>,
}

pub fn withdraw(ctx: Context<Withdraw>, amount: u64) -> Result<()> {
    let price = ctx.accounts.oracle.get_price();
    invoke(&ix, &[ctx.accounts.vault.clone()])?;
    vault.balance = vault.balance - amount;
    swap(pool, amount);
    Ok(())
}
"""
SAFE = """pub fn double_checked(value: u128) -> Option<u128> {
    value.checked_add(value)
}
"""


def ids_of(spark, text):
    return {r["id"] for r in raw_findings(source_string(spark, text)).select("id").collect()}


def test_vulnerable_sample_is_found(spark):
    assert {"SOL-001", "SOL-005", "SOL-020", "SOL-033", "SOL-051"} <= ids_of(spark, VULNERABLE)


@pytest.mark.parametrize("text", [SAFE, "", "// only a comment\n", "fn broken( {", "fn größe() { }\n"])
def test_harmless_texts_give_nothing(spark, text):
    assert ids_of(spark, text) == set()


def test_test_code_is_left_alone(spark):
    marked = VULNERABLE.replace("    let price", "    #[test]\n    let price")
    assert "SOL-005" not in ids_of(spark, marked)


def test_validated_scan_is_bounded_and_sorted(spark):
    out = validated_findings(source_string(spark, VULNERABLE, "programs/a/src/lib.rs", "a")).collect()
    assert all(15 <= r["confidence"] <= 95 and r["confidence"] >= 55 for r in out)
    assert len({(r["id"]) for r in out}) == len(out)
    assert "SOL-043" not in {r["id"] for r in out}


def test_units_and_context(spark):
    text = VULNERABLE + "\nfn helper(a: u64) -> u64 {\n    a\n}\n"
    src = source_string(spark, text)
    units = {r["fn_name"]: r for r in extract_units(src).collect()}
    assert set(units) == {"withdraw", "helper"}
    assert units["withdraw"]["line"] == 10 and units["helper"]["line"] == text[: text.index("fn helper")].count("\n") + 1
    joined = {r["fn_name"]: r["code"] for r in units_with_context(src).collect()}
    assert "pub vault: AccountInfo" in joined["withdraw"] and "ACCOUNTS_STRUCT" not in joined["helper"]


def test_behaviour_stops_after_key_theft(spark):
    js = [("node_modules/@a/b/i.js", "secretKey fetch( clipboard writeText( eval("), ("x/node_modules/c/i.js", "clipboard writeText( a"), ("d.js", "\\x41 eval( Function( String.fromCharCode"),
          ("min.js", "secretKey fetch(" + "a" * 10001)]
    df = spark.createDataFrame(js, "file_path string, content string")
    got = sorted((r["file_path"], r["package_name"], r["severity"]) for r in packs.scan_behaviour(df).collect())
    assert got == [("d.js", "unknown", "Medium"), ("node_modules/@a/b/i.js", "@a/b", "Critical"), ("x/node_modules/c/i.js", "c", "High")]


def test_safety_comment_lowers_severity(spark):
    text = "// SAFETY: fine\nunsafe { f() }\nunsafe { g() }\n// unsafe { h() }\nunsafe { invoke(x) }\n" + "\n" * 4 + "unsafe { y() }"
    out = packs.scan_unsafe(spark.createDataFrame([("f", text)], "file string, content string"))
    assert sorted((r["line_no"], r["severity"]) for r in out.collect()) == [(2, "Medium"), (3, "Medium"), (5, "Critical"), (10, "High")]


def test_near_validation_window(spark):
    lines = ["x"] * 40
    lines[3], lines[10], lines[30] = "require_keys_eq!(program, id)", "invoke(a)", "invoke(b)"
    out = packs.unanswered_lines(spark.createDataFrame([("f", "\n".join(lines))], "file string, content string"), packs.NEAR_CALL)
    assert [r["line_no"] for r in out.collect()] == [31]


def test_callbacks_and_custom_rules(spark):
    df = spark.createDataFrame([(1, "aaa"), (2, "b")], "n int, code string")
    from auditlake.rules.engine import rule, scan_callbacks

    assert [r["n"] for r in scan_callbacks(df, {"LEN": lambda s: s.str.len() > 2}).collect()] == [1]
    own = [rule("X-1", "has b", 2, some("b"))]
    assert [(r["n"], r["id"], r["severity"]) for r in scan_rules(df, own).collect()] == [(2, "X-1", 2)]


def test_same_named_files_keep_their_findings(spark):
    files = source_string(spark, VULNERABLE, "programs/a/mod.rs", "a").unionByName(source_string(spark, VULNERABLE, "programs/b/mod.rs", "a"))
    places = validated_findings(files).select("id", "n_locations").collect()
    alone = {r["id"]: r["n_locations"] for r in validated_findings(source_string(spark, VULNERABLE, "programs/a/mod.rs", "a")).collect()}
    assert {r["id"]: r["n_locations"] for r in places if r["id"] in alone} == {k: 2 * n for k, n in alone.items()}


@pytest.mark.parametrize("tokens", [3, 60])
def test_a_null_text_is_an_empty_text(spark, tokens):
    names = [f"token{k}" for k in range(tokens)]
    rules = [rule("X-1", "absent", 3, none(*names)), rule("X-2", "present", 3, some(*names))]
    units = spark.createDataFrame([(1, None), (2, ""), (3, "a token1 b")], "n int, code string")
    assert {(r["n"], r["id"]) for r in scan_rules(units, rules).collect()} == {(1, "X-1"), (2, "X-1"), (3, "X-2")}


FAMILIES = """use anchor_lang::prelude::*;
#[derive(Accounts)]
pub struct Pay<'info> {
    #[account(mut)]
    pub source: AccountInfo<'info>,
    #[account(mut)]
    pub destination: AccountInfo<'info>,
    #[account(init_if_needed, close = owner)]
    pub state: Account<'info, State>,
}
pub fn pay(source: AccountInfo<'info>, amount: u64) -> Result<()> {
    let total = amount + fee;
    token::transfer(source, total)?;
    send(amount, source);
    let raw = ctx.remaining_accounts;
    unsafe { ptr::write(p, v) }
}
fn send(value: u64, to: AccountInfo<'info>) {
    invoke(value, to);
}
"""


def test_scan_unions_all_families(spark):
    files = source_string(spark, FAMILIES, "programs/a/src/lib.rs", "a").unionByName(
        spark.createDataFrame([("b", "b.rs", "b.rs", None), ("c", "c.rs", "c.rs", "")], "program string, file_path string, file_name string, content string"))
    found = {(r["id"], r["seq"]["family"]) for r in all_findings(files).collect()}
    assert {f for _, f in found} == {0, 1, 2, 3, 4, 5, 6, 7, 8}
    assert {"SOL-TAINT-02", "SOL-TAINT-IP-01", "SOL-CPI-transfer", "SOL-ALIAS-02", "SOL-074", "SOL-071", "SOL-093", "SOL-094", "SOL-072"} <= {i for i, _ in found}


def test_scan_report_returns_the_places(spark):
    files = source_string(spark, FAMILIES, "programs/a/x/mod.rs", "a").unionByName(source_string(spark, FAMILIES, "programs/a/y/mod.rs", "a"))
    findings, places = scan_report(files)
    n = {r["id"]: r["n_locations"] for r in findings.collect()}
    further = {}
    for r in places.collect():
        further[r["id"]] = further.get(r["id"], 0) + 1
    assert n and {k: v - 1 for k, v in n.items() if v > 1} == further
    assert n == {r["id"]: r["n_locations"] for r in validated_findings(files).collect()}


def test_patterns_come_last_and_start_at_words(spark):
    tree = every(line(regex("x")), regex(r"(?i)\w*(?:admin|owner)\s*=", "="), none("checked_"))
    sql = condition_sql(tree, "code")
    assert sql.index("checked_") < sql.index("admin") < sql.index("split(") and "rlike '(?i)(?:admin|owner)" in sql
    texts = ["my_Admin = x", "admin == x\nchecked_", "owner x", "", "x\nthe_owner= 1"]
    df = spark.createDataFrame([(t,) for t in texts], "code string")
    assert [r[0] for r in df.selectExpr(sql).collect()] == [True, False, False, False, True]


def test_gates_hold_wherever_their_pattern_is_found(spark):
    """Gated patterns of the structure pack fire as they do without a gate, in either case of letters."""
    bare = lambda t: t if isinstance(t, str) else ["regex", t[1]] if t[0] == "regex" else [t[0], *(bare(p) if isinstance(p, (str, list)) else p for p in t[1:])]
    texts = ["x.set_authority(a)", "x.my_change_owner2(a)", "MyAdmin = Ctx.ACCOUNTS.x", "owner = a.Key()", "p.get_PRICE()", "x.Oracle", "d.try_deserialize(x)", "T.unpack(x)", "a.try_from_slice(b)", "Owner = 1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, code string")
    hits = lambda rules: sorted((r["i"], r["id"]) for r in scan_rules(df, rules, keep=["i"]).collect())
    plain = [{**r, "when": bare(r["when"])} for r in STRUCTURE]
    assert hits(STRUCTURE) == hits(plain) and len(hits(STRUCTURE)) > 6 and plain != STRUCTURE


def test_evidence_is_the_same_from_the_files_and_from_the_own_row(spark):
    """Findings that carry their text and are asked about all ids at once are cleared as single ones joined with their files."""
    from auditlake.rules import context as ctx
    from auditlake.rules.mitigations import MITIGATIONS, SHARED, proven_safe, with_evidence

    texts = [VULNERABLE, VULNERABLE + "\nfn get_x() {}\n", "use anchor_lang::prelude::*;\nfn a(x: AccountInfo<'info>) {\n    invoke_signed(x);\n    let t = twap;\n}\n", "fn b() {\n    1\n}\n"]
    rows = [(f"p{i % 2}", f"src/f{i}.rs", f"f{i}.rs", t) for i, t in enumerate(texts)] + [("p0", None, None, texts[2])]
    files = spark.createDataFrame(rows, "program string, file_path string, file_name string, content string")
    units = units_with_context(files.withColumn("src", F.when(F.col("file_path").isNotNull(), F.col("content"))), keep=["program", "file_path", "file_name", "src"])
    found = units.select("program", "file_path", F.coalesce("file_name", F.lit("x")).alias("location"), F.col("fn_name").alias("function_name"),
                         F.col("line").alias("line_number"), F.col("code").alias("vulnerable_code"), "src")
    ids = [*MITIGATIONS, *SHARED, "SOL-999"]
    context, functions = ctx.project_context(files), ctx.function_signals(files)
    one = with_evidence(found.drop("src").withColumn("id", F.explode(F.lit(ids))), files.where("file_path is not null"), context, functions)
    all_at_once = with_evidence(found, None, context, functions, ids)
    shown = lambda df: sorted(map(str, df.select("program", "file_path", "function_name", "line_number", "id", proven_safe().alias("safe")).collect()))
    assert shown(one) == shown(all_at_once)
    safe = {r["safe"] for r in one.select(proven_safe().alias("safe")).collect()}
    assert safe == {True, False}
