"""Findings of the detector families beside the text rules, all in one shape: taint, calls, accounts, unsafe code, arithmetic.

Line and struct families stay in the file's own row. Taint levels run to their fixpoint in one row for each unit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import severity_rank
from auditlake.operators import cfg, code
from auditlake.operators.findings import union_findings
from auditlake.operators.graph import level_step, raise_levels
from auditlake.rules import packs
from auditlake.session import write_cut
from auditlake.sources.corpus import extract_structs, extract_units

FILE = ["program", "file_path", "file_name"]
UNIT = [*FILE, "unit_no", "fn_name"]

# Exported id, type and category of each account check, by the check's own id.
ACCOUNT_CHECKS = {
    "SOL-ALIAS-02": ("SOL-ALIAS-02", "Raw AccountInfo Without Type Safety", "Account Safety"),
    "SOL-ALIAS-03": ("SOL-ALIAS-03", "UncheckedAccount Without CHECK Comment", "Account Safety"),
    "SOL-ALIAS-04": ("SOL-ALIAS-04", "Token Account Without Mint Verification", "Account Safety"),
    "SOL-ALIAS-05": ("SOL-ALIAS-05", "Authority Account Without Signer Check", "Authorization"),
    "CLOSE-01": ("SOL-074", "Re-Initialization via init_if_needed", "Account Safety"),
    "CLOSE-02": ("SOL-070", "Close Account Drain", "Account Safety"),
    "CLOSE-03": ("SOL-074", "Re-Initialization via init_if_needed", "Account Safety"),
    "PDA-01": ("SOL-073", "Insecure PDA Derivation", "Cryptographic"),
    "PDA-02": ("SOL-073", "Insecure PDA Derivation", "Cryptographic"),
    "PDA-03": ("SOL-073", "Insecure PDA Derivation", "Cryptographic"),
    "CONFUSION-01": ("SOL-076", "Account Type Confusion", "Type Safety"),
    "CONFUSION-02": ("SOL-076", "Account Type Confusion", "Type Safety"),
}
#: Confidence of a converted account check and of the line families.
CONVERTED, UNSAFE, ARITHMETIC, CROSS_FUNCTION = 50, 45, 42, 60


def _shape(
    df: DataFrame, family: int, line: Column, fn: Column, rule: Column, kind: Column, severity: Column, category: Column, text: Column,
    confidence: Column, cwe: Column | str | None = None, mark: Column | None = None,
) -> DataFrame:
    """The common finding columns; seq orders findings by family, file, line, id and mark."""
    mark = F.lit("") if mark is None else mark
    order = F.struct(
        F.lit(family).alias("family"), F.col("file_path"), line.cast("int").alias("place"), F.lit(0).alias("pos"),
        F.concat_ws("/", rule, kind, mark).alias("mark"))
    return df.select(
        "program", "file_path", F.col("file_name").alias("location"), fn.alias("function_name"), line.cast("int").alias("line_number"),
        rule.alias("id"), kind.alias("vuln_type"), severity.cast("int").alias("severity"), category.alias("category"),
        (cwe if isinstance(cwe, Column) else F.lit(cwe)).cast("string").alias("cwe"), text.alias("vulnerable_code"), confidence.cast("int").alias("confidence"), order.alias("seq"))


def unit_levels(units: DataFrame, stmts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, var, level): taint level of every variable of every unit. Parameters start by their type, assignments run to the
    fixpoint. Statements of units that extract_units has cut may carry `seeds` (with_parameter_levels); they are then read once, in
    one pass. Otherwise the assignments are written and meet the parameters, which are read from the units."""
    head = F.col("code").rlike(r"^(?:pub )?fn\s")
    if "seeds" in stmts.columns:
        return raise_levels(_level_steps(stmts.withColumn("code", F.when(~head, F.col("code"))), keys), None, keys, small=True).withColumnRenamed("node", "var")
    assigned = write_cut(code.assignments(stmts.filter(~head), keys))
    params = code.parameters(units, keys).filter("level is not null").select(*keys, F.col("param").alias("node"), "level")
    fixed = assigned.filter("fixed_level is not null").select(*keys, F.col("lhs").alias("node"), F.col("fixed_level").alias("level"))
    edges = assigned.filter("fixed_level is null").select(
        *keys, F.explode("rhs_vars").alias("src"), F.col("lhs").alias("dst"), F.col("is_arithmetic").alias("lifts"))
    return raise_levels(edges, params.unionByName(fixed), keys, small=True).withColumnRenamed("node", "var")


def _level_steps(stmts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `steps` of each assignment; the first line of a unit, which is always a statement, brings the parameters."""
    first = F.col("node") == 1
    rows = code.assignments(stmts, [*keys, "seeds"], also=first)
    start = F.when(first, F.transform("seeds", lambda s: level_step(s["node"], level=s["level"])))
    # as in joins, edges without a key lead nowhere
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    along = F.when(named, F.transform("rhs_vars", lambda v: level_step(v, F.col("lhs"), F.col("is_arithmetic"))))
    own = F.when(F.col("lhs").isNull(), F.lit(None)).when(F.col("fixed_level").isNull(), along).otherwise(F.array(level_step(F.col("lhs"), level=F.col("fixed_level"))))
    return rows.select(*keys, F.flatten(F.array_compact(F.array(start, own))).alias("steps"))


def taint_findings(units: DataFrame, stmts: DataFrame, internal: DataFrame) -> DataFrame:
    """Tainted variables at sinks, and tainted arguments of functions that pass them to a sink."""
    levels = unit_levels(units, stmts, UNIT)
    sinks = code.tainted_sinks(code.taint_sink_uses(stmts, [*UNIT, "code"]), levels, UNIT)
    inside = _shape(
        sinks, 1, F.col("line_no"), F.col("fn_name"), F.col("id"), F.concat(F.lit("Tainted Data Reaching "), "operation"), F.col("severity"),
        F.lit("Information Flow"), F.col("code"), F.col("confidence"), "CWE-20", F.col("var"))
    calls = internal.withColumn("call_text", F.concat("callee", F.lit("("), F.array_join("args", ", "), F.lit(")")))
    known = levels.groupBy("program", "fn_name", "var").agg(F.max("level").alias("level"))
    passed = code.apply_summaries(calls, code.transitive_summaries(code.fn_summaries(units, UNIT), internal, UNIT), known, keep=["file_path", "file_name", "call_text"])
    kind = F.concat(F.lit("Cross-Function Taint: "), "caller", F.lit(" to "), "callee", F.lit(" (param "), "param", F.lit(")"))
    across = _shape(
        passed, 2, F.col("line_no"), F.col("caller"), F.lit("SOL-TAINT-IP-01"), kind, F.col("severity"), F.lit("Interprocedural Information Flow"),
        F.col("call_text"), F.lit(CROSS_FUNCTION), "CWE-20", F.col("pos").cast("string"))
    return union_findings(inside, across)


def call_findings(units: DataFrame, external: DataFrame) -> DataFrame:
    """Calls out of the program that need checks their caller lacks."""
    hits = code.dangerous_calls(external, units, UNIT)
    oracle = F.col("id") == "SOL-CPI-02"
    kind = F.when(oracle, "Unvalidated Oracle Data in CPI").otherwise(F.concat(F.lit("Unvalidated CPI Call: "), "callee"))
    return _shape(hits, 3, F.col("line_no"), F.col("fn_name"), F.col("id"), kind, F.col("severity"), F.lit("Cross-Crate CPI"), F.col("path"),
                  F.col("confidence"), mark=F.col("path"))


def account_findings(files: DataFrame) -> DataFrame:
    """Field checks of the account structs. A finding's function is `Struct::field`, its code the field's declaration."""
    structs = extract_structs(files, keep=FILE)
    keys = [*FILE, "struct_no", "struct_name", "body"]
    alias = code.aliasing_findings(structs, keys).select(*keys, "id", "field", "severity", "confidence")
    safety = packs.account_safety(structs, keys).select(*keys, "id", "field", severity_rank(F.col("severity")).alias("severity"), F.lit(CONVERTED).alias("confidence"))
    found = alias.unionByName(safety).filter(F.col("id").isin(*ACCOUNT_CHECKS))
    named = F.expr("case id " + " ".join(
        f"when '{k}' then named_struct('id', '{i}', 'kind', '{kind}', 'category', '{c}')" for k, (i, kind, c) in ACCOUNT_CHECKS.items()) + " end")
    found = found.withColumn("_n", named)
    pairs = packs.duplicate_mutable(structs, keys)
    said = lambda field: F.trim(F.get(F.filter(F.split("body", "\n"), lambda x: F.contains(x, F.concat(field, F.lit(":")))), F.lit(0)))
    place = lambda field: F.concat(F.col("struct_name"), F.lit("::"), field)
    one = _shape(found, 4, F.lit(0), place(F.col("field")), F.col("_n.id"), F.col("_n.kind"), F.col("severity"), F.col("_n.category"), said(F.col("field")),
                 F.col("confidence"), mark=F.concat_ws("/", F.col("struct_no").cast("string"), "id", "field"))
    both = F.concat_ws("\n", said(F.col("account_a")), said(F.col("account_b")))
    two = _shape(pairs, 5, F.lit(0), place(F.col("account_a")), F.lit("SOL-071"), F.lit("Duplicate Mutable Accounts"), F.lit(4), F.lit("Account Safety"), both,
                 F.lit(CONVERTED), mark=F.concat_ws("/", F.col("struct_no").cast("string"), "account_a", "account_b"))
    return union_findings(one, two)


def line_findings(files: DataFrame) -> DataFrame:
    """Unsafe constructs, arithmetic issues and remaining accounts that nothing nearby checks."""
    unsafe = packs.scan_unsafe(files, keep=FILE)
    first = _shape(unsafe, 6, F.col("line_no"), F.lit(""), F.lit("SOL-093"), F.col("category"), severity_rank(F.col("severity")), F.lit("Unsafe Code"), F.trim("line"),
                   F.lit(UNSAFE), mark=F.col("id"))
    sums = packs.scan_arithmetic(files, keep=FILE)
    level = F.when(F.col("cvss") >= 8, 5).when(F.col("cvss") >= 6, 4).when(F.col("cvss") >= 4, 3).otherwise(2)
    second = _shape(sums, 7, F.col("line_no"), F.lit(""), F.lit("SOL-094"), F.col("kind"), level, F.lit("Arithmetic"), F.trim("line"), F.lit(ARITHMETIC), "CWE-190")
    bare = packs.unanswered_lines(files, packs.NEAR_REMAINING, keep=FILE)
    third = _shape(bare, 8, F.col("line_no"), F.lit(""), F.lit("SOL-072"), F.lit("Unchecked Remaining Accounts"), F.lit(4), F.lit("Input Validation"), F.trim("line"),
                   F.lit(CONVERTED))
    return union_findings(first, second, third)


# Type, severity, category, weakness and confidence of each control-flow and data-flow rule, and exported ids.
FLOW_RULES = {
    "SOL-CFG-01": ("Not Dominated by Auth Check", 5, "Authorization", "CWE-862", 82),
    "SOL-CFG-02": ("Without Any Authorization", 5, "Authorization", "CWE-862", 90),
    "SOL-CFG-03": ("State Mutation After CPI (CEI Violation)", 5, "Reentrancy", "CWE-841", 85),
    "SOL-CFG-04": ("Potentially Unbounded Loop", 4, "Denial of Service", "CWE-834", 68),
    "SOL-090": ("Potentially Uninitialized Variable Use", 3, "Data Flow", "CWE-457", 40),
    "SOL-091": ("Dead Store / Unused Assignment", 1, "Data Flow", "CWE-563", 30),
}


def flow_findings(units: DataFrame) -> DataFrame:
    """Control-flow findings of every unit, and reads before and settings without a use. Declared variables that are never read are no
    findings."""
    def rule(part: int) -> Column:
        out = F.lit(None)
        for rule_id, values in FLOW_RULES.items():
            out = F.when(F.col("id") == rule_id, F.lit(values[part])).otherwise(out)
        return out

    flow = cfg.cfg_findings(units, [*UNIT, "unit_line"])
    what = F.when(F.col("kind") == "transfer", "Token Transfer ").when(F.col("kind") == "cpi", "CPI Call ").otherwise("")
    first = _shape(
        flow, 9, F.col("unit_line") + F.col("line"), F.col("fn_name"), F.col("id"), F.concat(what, rule(0)), rule(1), rule(2), F.substring_index("code", "\n", 1), rule(4),
        rule(3), F.col("node").cast("string"))
    data = cfg.cfg_dataflow(units, [*UNIT, "unit_line"]).where("id <> 'DF-SOL-091' OR NOT declared").withColumn("id", F.replace("id", F.lit("DF-"), F.lit("")))
    second = _shape(
        data, 10, F.col("unit_line") + F.col("line"), F.col("fn_name"), F.col("id"), rule(0), rule(1), rule(2), F.col("var"), rule(4), rule(3), F.concat_ws("/", F.col("node").cast("string"), "var"))
    return union_findings(first, second)


def family_findings(files: DataFrame) -> DataFrame:
    """Findings of all families. files: program, file_path, file_name, content. A null text counts as empty. Units and their statements
    are cut once and written for all families."""
    files = files.select(*FILE, F.coalesce("content", F.lit("")).alias("content"))
    units = write_cut(extract_units(files, keep=FILE))
    stmts = write_cut(code.unit_statements(units, UNIT))
    internal, external = code.call_edges(write_cut(code.call_sites(stmts, UNIT)), units)
    flows = flow_findings(units.withColumnRenamed("line", "unit_line"))
    return union_findings(taint_findings(units, stmts, internal), call_findings(units, external), account_findings(files), line_findings(files), flows)
