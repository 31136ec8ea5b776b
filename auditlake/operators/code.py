"""Relations drawn from code units: statements, assignments, calls, summaries, account fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import statements as st
from auditlake.functions.text import has, has_any, line_array
from auditlake.operators.graph import reachable
from auditlake.operators.ordered import running_total

UNIT_KEYS = ["program", "file_path", "fn_name"]


def unit_statements(units: DataFrame, keys=UNIT_KEYS, text: str = "code", first: str = "line") -> DataFrame:
    """Statements (non-blank, non-comment lines): keys, node (from 1), line_no, code, stmt_kind."""
    lines = units.select(*keys, first, F.posexplode(line_array(F.col(text))).alias("_i", "_t"))
    code = F.trim("_t")
    kept = lines.filter((code != "") & ~code.startswith("//") & ~code.rlike(r"^[{}()\[\];,]*$"))
    return kept.select(
        *keys, (F.col("_i") + 1).alias("node"), (F.col(first) + F.col("_i")).alias("line_no"), code.alias("code"),
        st.classify_stmt(code).alias("stmt_kind"),
    )


def assignments(stmts: DataFrame, keys=UNIT_KEYS, also: Column | None = None) -> DataFrame:
    """(lhs, rhs_vars, fixed level, is_arithmetic) of statements that assign. Rows where also holds stay without an assignment, with
    a null lhs."""
    lhs, rhs = st.assignment(F.col("code"))
    # a filter on what a generator makes stays above it, so the patterns aren't looked for once more in the filter
    rows = stmts.select(*keys, "node", "line_no", "code", F.explode_outer(F.array(F.struct(lhs.alias("lhs"), rhs.alias("rhs")))).alias("_a"))
    assigns = F.col("_a.lhs").isNotNull()
    return rows.filter(assigns if also is None else assigns | also).select(
        *keys, "node", "line_no", F.col("_a.lhs").alias("lhs"), st.variables(F.col("_a.rhs")).alias("rhs_vars"),
        st.fixed_level(F.col("code")).alias("fixed_level"), st.is_arithmetic(F.col("code")).alias("is_arithmetic"))


# A word is taken whole: what may follow it is no part of a word, so no shorter one can match.
CALL = r"(\b[A-Za-z_]\w*+(?:::\w++)*+)\s*+\(([^()]*+)\)"
NOT_CALLS = ("if", "for", "while", "match", "fn", "return", "Ok", "Err", "Some")


def call_sites(stmts: DataFrame, keys=UNIT_KEYS) -> DataFrame:
    """(caller, callee, args, line_no) for every call in a statement, known or not."""
    rows = stmts.filter(has(F.col("code"), "(") & ~F.col("code").rlike(r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s"))
    # statements are searched once, for whole calls; a path has no bracket and no blank, arguments have no bracket
    rows = rows.select(*keys, "line_no", F.regexp_extract_all("code", F.lit(CALL), F.lit(0)).alias("_all"))
    rows = rows.select(*keys, "line_no", F.explode_outer("_all").alias("_call")).filter("_call is not null")
    path, args = F.regexp_extract("_call", r"^[\w:]+", 0), F.expr("substring(_call, instr(_call, '(') + 1, length(_call) - instr(_call, '(') - 1)")
    rows = rows.select(*keys, "line_no", path.alias("path"), args.alias("args"))
    name = F.substring_index("path", "::", -1)
    return rows.select(
        *[F.col(k) for k in keys], F.col(keys[-1]).alias("caller"), name.alias("callee"), "path",
        F.when(F.trim("args") == "", F.array().cast("array<string>")).otherwise(F.split("args", r"\s*,\s*")).alias("args"), "line_no",
    ).filter(~F.col("callee").isin(*NOT_CALLS))


def mark_calls(sites: DataFrame, units: DataFrame, by: str = "program") -> DataFrame:
    """sites with `internal`: whether the same program has a function of that name."""
    known = units.select(by, F.col("fn_name").alias("callee")).distinct().withColumn("_known", F.lit(True))
    return sites.join(known, [by, "callee"], "left").withColumn("internal", F.col("_known").isNotNull()).drop("_known")


def call_edges(sites: DataFrame, units: DataFrame, by: str = "program") -> tuple[DataFrame, DataFrame]:
    """(internal, external): calls to functions of the same program, and all others."""
    marked = mark_calls(sites, units, by)
    return marked.filter("internal").drop("internal"), marked.filter("not internal").drop("internal")


PARAMETER_LIST = r"fn\s+\w+[^(]*\(([^)]*)\)"
PARAMETER = r"(?:mut\s+)?(\w+)\s*:\s*([^,<>]*(?:<[^<>]*>)?)"


def with_parameters(units: DataFrame, text: str = "code") -> DataFrame:
    """Add `params`: the names of each function's parameters in order, so that its calls can carry them."""
    return units.withColumn("params", F.regexp_extract_all(F.regexp_extract(text, PARAMETER_LIST, 1), F.lit(PARAMETER), F.lit(1)))


def parameters(units: DataFrame, keys=UNIT_KEYS, text: str = "code") -> DataFrame:
    """(pos, param, type_text, level) of each function's parameters."""
    listed = units.filter(F.col(text).isNotNull()).select(*keys, text, F.regexp_extract(text, PARAMETER_LIST, 1).alias("_listed"))
    full, types = (F.regexp_extract_all("_listed", F.lit(PARAMETER), F.lit(i)) for i in (1, 2))
    rows = listed.select(*keys, text, F.posexplode(F.arrays_zip(full.alias("p"), types.alias("t"))).alias("pos", "_x"))
    return rows.select(
        *keys, text, "pos", F.col("_x.p").alias("param"), F.replace(F.col("_x.t"), F.lit(" "), F.lit("")).alias("type_text")
    ).withColumn("level", st.param_level(F.col("type_text")))


def with_parameter_levels(units: DataFrame, text: str = "code") -> DataFrame:
    """Add `seeds`: (node, level) of each function's parameters whose type has a level, so that its statements can carry them."""
    rows = units.withColumn("_listed", F.regexp_extract(text, PARAMETER_LIST, 1))
    names, types = (F.regexp_extract_all("_listed", F.lit(PARAMETER), F.lit(i)) for i in (1, 2))
    levels = F.transform(
        F.arrays_zip(names.alias("p"), types.alias("t")),
        lambda x: F.struct(x["p"].alias("node"), st.param_level(F.replace(x["t"], F.lit(" "), F.lit(""))).alias("level")))
    return rows.withColumn("seeds", F.filter(levels, lambda x: x["level"].isNotNull())).drop("_listed")


# Tokens of lines that return a value or reach a sink.
RETURNS = ("return", "Ok(")
SINK_LINES = ("transfer", "invoke", "CpiContext")


def fn_summaries(units: DataFrame, keys=UNIT_KEYS, text: str = "code", returns=RETURNS, sinks=SINK_LINES) -> DataFrame:
    """Per parameter: does a returning line name it, does a sink line name it."""
    # the lines that count are picked once for each function, not for each parameter
    body = F.slice(F.split(F.col(text), "\n"), 2, 1_000_000_000)
    lines = {name: F.filter(body, lambda x: has_any(x, tokens)) for name, tokens in (("_returns", returns), ("_sinks", sinks))}
    params = parameters(units.withColumns(lines), [*keys, *lines], text)
    named = lambda name: F.exists(name, lambda x: F.contains(x, F.col("param")))
    return params.select(*keys, "pos", "param", "type_text", "level", named("_returns").alias("returns"), named("_sinks").alias("reaches_sink"))


def transitive_summaries(summaries: DataFrame, sites: DataFrame, keys=UNIT_KEYS, by: str = "program") -> DataFrame:
    """summaries whose reaches_sink also holds for parameters that a call passes on to one that reaches a sink, over any number of calls;
    sink_hops counts the calls in between (0: the function's own line, null: no sink).

    A parameter of a function is a node and a call that names it in an argument an edge, so chains and recursion end in one fixpoint
    over nodes; functions of one name in a program are one, as calls don't tell them apart. Sites that carry their function's `params`
    (with_parameters) need no join for them; summaries may then be one row for each program, function name and pos."""
    node = lambda fn, pos: F.struct(F.col(fn).alias("fn"), F.col(pos).alias("pos"))
    carried = ["params"] if "params" in sites.columns else []
    passed = sites.select(*keys, *carried, "callee", F.posexplode("args").alias("at", "arg"))
    if carried:
        used = passed.dropna(subset=list(keys)).withColumn("_vars", st.variables(F.col("arg")))
        named = F.filter(F.transform("params", lambda p, i: F.struct(p.alias("param"), i.alias("pos"))), lambda x: F.array_contains("_vars", x["param"]))
        flows = used.select(*keys, "callee", "at", F.inline(named).alias("param", "pos"))
    else:
        flows = passed.withColumn("param", F.explode(st.variables(F.col("arg")))).join(summaries.select(*keys, "pos", "param"), [*keys, "param"])
    flows = flows.select(by, node("callee", "at").alias("src"), node(keys[-1], "pos").alias("dst")).distinct()
    seeds = summaries.where("reaches_sink").select(by, node(keys[-1], "pos").alias("node")).distinct()
    reached = reachable(flows, seeds, [by]).select(by, F.col("node.fn").alias("_fn"), F.col("node.pos").alias("pos"), F.col("hops").alias("sink_hops"))
    joined = summaries.withColumn("_fn", F.col(keys[-1])).join(reached, [by, "_fn", "pos"], "left").drop("_fn")
    return joined.withColumn("reaches_sink", F.col("sink_hops").isNotNull())


def apply_summaries(edges: DataFrame, summaries: DataFrame, levels: DataFrame, by: str = "program", keep=()) -> DataFrame:
    """Arguments that carry account input or worse into a parameter that reaches a sink.

    edges: by, caller, callee, args, line_no and the columns of keep, which ride along; levels: by, fn_name, var, level.
    """
    args = edges.select(by, *keep, "caller", "callee", "line_no", F.posexplode("args").alias("pos", "arg"))
    target = summaries.filter("reaches_sink").select(by, F.col("fn_name").alias("callee"), "pos", "param").distinct()
    used = args.join(target, [by, "callee", "pos"]).withColumn("var", F.explode(st.variables(F.col("arg"))))
    known = levels.select(by, F.col("fn_name").alias("caller"), "var", "level")
    joined = used.join(known, [by, "caller", "var"])
    level = joined.groupBy(by, *keep, "caller", "callee", "line_no", "pos", "param").agg(F.max("level").alias("level"))
    return level.filter(F.col("level") >= st.ACCOUNT).withColumn("severity", F.when(F.col("level") == st.TAINTED, 5).otherwise(4))


# Taint sinks (id, operation, highest level that is fine, lowest level that counts).
TAINT_SINKS = (
    ("SOL-TAINT-01", "Token Transfer", st.SIGNER, 0),
    ("SOL-TAINT-02", "CPI Invocation", st.SIGNER, 0),
    ("SOL-TAINT-03", "Authority Check", st.UNTAINTED, 0),
    ("SOL-TAINT-04", "State Update", st.SIGNER, st.ACCOUNT),
    ("SOL-TAINT-05", "PDA Derivation", st.SIGNER, st.ACCOUNT),
)


def taint_sink_uses(stmts: DataFrame, keys=UNIT_KEYS) -> DataFrame:
    """(id, operation, max_level, min_level, var) for each variable at a sink statement."""
    code = F.col("code")
    _, rhs = st.assignment(code)
    used = st.variables(F.coalesce(F.nullif(rhs, F.lit("")), code))
    tests = {
        "SOL-TAINT-01": (has_any(code, ("transfer", "Transfer")), lambda v: has_any(v, ("amount", "lamport", "value"))),
        "SOL-TAINT-02": (has_any(code, ("invoke", "CpiContext")), None),
        "SOL-TAINT-03": (has(code, "authority") & has(code, "key") & has(code, "=="), lambda v: has(v, "key")),
        "SOL-TAINT-04": (has_any(code, ("+=", "-=", "borrow_mut")) & ~has(code, "checked_"), None),
        "SOL-TAINT-05": (has_any(code, ("find_program_address", "create_program_address")), None),
    }
    parts = []
    for rule_id, operation, top, low in TAINT_SINKS:
        cond, test = tests[rule_id]
        names = used if test is None else F.filter(used, test)
        parts.append(F.when(cond, F.struct(F.lit(rule_id).alias("id"), F.lit(operation).alias("operation"), F.lit(top).alias("max_level"),
                                           F.lit(low).alias("min_level"), names.alias("vars"))))
    rows = stmts.select(*keys, "node", "line_no", F.explode_outer(F.array(*parts)).alias("_u")).filter("_u is not null")
    rows = rows.select(*keys, "node", "line_no", *[f"_u.{c}" for c in ("id", "operation", "max_level", "min_level")], F.explode_outer("_u.vars").alias("var"))
    return rows.filter("var is not null")


def tainted_sinks(uses: DataFrame, levels: DataFrame, keys=UNIT_KEYS) -> DataFrame:
    """Sink uses whose variable is at or above the sink's limit. levels: keys, var, level."""
    hit = (F.col("level") >= F.greatest(F.col("max_level"), F.col("min_level"))) & (F.col("level") > 0)
    confidence = (
        F.when(F.col("level") == 5, 85).when(F.col("level") == 4, 78).when(F.col("level") == 3, 72)
        .when(F.col("level") == 2, 65).otherwise(50)
    )
    joined = uses.join(levels, [*keys, "var"]).filter(hit)
    return joined.withColumns({"severity": F.when(F.col("level") == 5, 5).otherwise(4), "confidence": confidence})


# --- calls that need care -----------------------------------------------------------------------

# Dangerous callee parts with their severity; the first match in this order decides.
DANGEROUS_CALLS = (
    ("transfer_checked", 5), ("freeze_account", 4), ("thaw_account", 4), ("system_transfer", 5), ("system_create_account", 4),
    ("withdraw_nonce", 5), ("advance_nonce", 4), ("transfer_signed", 5), ("mint_to_checked", 5), ("burn_checked", 5),
    ("mint_to", 5), ("burn", 5), ("freeze", 4), ("thaw", 4), ("set_authority", 5), ("close_account", 4), ("close", 4),
    ("transfer", 5), ("ata_create", 3), ("create_idempotent", 3), ("recover", 4), ("allocate", 4), ("assign", 5),
)
ORACLE_CALLEES = ("pyth", "oracle", "switchboard")


def has_signer_check(code: Column) -> Column:
    return (
        has_any(code, ("require_signed", ".is_signer", "assert_keys_equal")) | (has(code, "require!") & has(code, "signer"))
        | (has(code, "require_eq!") & has(code, "authority"))
    )


def has_amount_check(code: Column) -> Column:
    bounded = has(code, "require!") & has_any(code, ("amount > 0", "amount <", "> 0", "<= max", "amount <= ", "amount >="))
    return bounded | has_any(code, ("checked_", "try_add", "try_sub", "try_mul"))


def has_price_check(code: Column) -> Column:
    used = has_any(code, ("confidence", ".price", "pyth::", "switchboard"))
    general = has(code, "require!") & has_any(code, ("confidence", "price > 0", ".valid", "stale", "status == ", "conf > "))
    switch = has(code, "switchboard") & has_any(code, ("result.is_ok()", "result.ok()", "is_err()"))
    pyth = has(code, "pyth") & has_any(code, ("price_confidence", "price_ema", ".valid", "conf < "))
    return used & (general | switch | pyth)


#: Columns that say which checks a function has.
CALL_CHECKS = ["_signer", "_amount", "_price"]


def with_call_checks(units: DataFrame, text: str = "code") -> DataFrame:
    """Add CALL_CHECKS, so that a function's calls can carry them."""
    code = F.col(text)
    return units.withColumns(dict(zip(CALL_CHECKS, (has_signer_check(code), has_amount_check(code), has_price_check(code)), strict=True)))


def dangerous_calls(external: DataFrame, units: DataFrame, keys=UNIT_KEYS) -> DataFrame:
    """External calls that match the dangerous list (or an oracle) in a caller without the checks. Calls that carry CALL_CHECKS are
    judged in their own rows, others meet their caller by keys; a call without a key has no caller."""
    callee = F.lower("path")
    pattern = F.lit(None).cast("string")
    base = F.lit(None).cast("int")
    for name, severity in reversed(DANGEROUS_CALLS):
        pattern = F.when(F.contains(callee, F.lit(name)), F.lit(name)).otherwise(pattern)
        base = F.when(F.contains(callee, F.lit(name)), F.lit(severity)).otherwise(base)
    calls = external.withColumns({"pattern": pattern, "_sev": base, "_oracle": has_any(callee, ORACLE_CALLEES)}).filter("pattern is not null or _oracle")
    if set(CALL_CHECKS) <= set(external.columns):
        calls = calls.dropna(subset=list(keys))
    else:
        calls = calls.join(with_call_checks(units).select(*keys, *CALL_CHECKS).dropDuplicates(keys), keys)
    call = F.when(
        F.col("pattern").isNotNull() & ~(F.col("_signer") & F.col("_amount")),
        F.struct(F.concat(F.lit("SOL-CPI-"), "pattern").alias("id"), F.when(~F.col("_signer"), 5).otherwise(F.col("_sev")).alias("severity"),
                 F.when(~F.col("_signer"), 80).otherwise(70).alias("confidence")))
    oracle = F.when(F.col("_oracle") & ~F.col("_price"), F.struct(
        F.lit("SOL-CPI-02").alias("id"), F.lit(4).alias("severity"), F.lit(65).alias("confidence")))
    return calls.select(*keys, "callee", "path", "line_no", F.inline(F.array_compact(F.array(call, oracle))))


# --- call targets -------------------------------------------------------------------------------

# Tokens that name a well-known program, and the program.
KNOWN_TARGETS = (
    ("token::ID", "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA"),
    ("system_program::ID", "11111111111111111111111111111111"),
    ("spl_token::id()", "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA"),
    ("associated_token::ID", "ATokenGPvbdGVxr1b2hvZbsiqW5xWH25efTNsLJA8knL"),
    ("spl_associated_token_account", "ATokenGPvbdGVxr1b2hvZbsiqW5xWH25efTNsLJA8knL"),
    ("anchor_spl::token", "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA"),
    ("rent::ID", "SysvarRent111111111111111111111111111111111"),
    ("clock::ID", "SysvarC1ock11111111111111111111111111111111"),
)
UNKNOWN_TARGET = "UnknownProgram"


def cpi_targets(units: DataFrame, keys: list[str], text: str = "code") -> DataFrame:
    """(callee, call_type) of each unit; raw calls without a known target go to the unknown program."""
    code = F.col(text)
    raw = has_any(code, ("invoke(", "invoke_signed("))
    kind = (
        F.when(has_any(code, ("CpiContext::new", "anchor_spl")), "AnchorCPI").when(has(code, "invoke_signed"), "InvokeSigned")
        .when(has(code, "invoke("), "RawInvoke").otherwise("Unknown")
    )
    known = F.array_compact(F.array(*[F.when(has(code, token), F.lit(pid)) for token, pid in KNOWN_TARGETS]))
    covered = (F.size(known) > 0) & kind.isin("RawInvoke", "InvokeSigned")
    rest = F.when(raw & ~covered, F.struct(
        F.lit(UNKNOWN_TARGET).alias("callee"), F.when(has(code, "invoke_signed("), "InvokeSigned").otherwise("RawInvoke").alias("call_type")))
    listed = F.transform(known, lambda p: F.struct(p.alias("callee"), kind.alias("call_type")))
    return units.select(*keys, F.inline(F.concat(listed, F.array_compact(F.array(rest)))))


# --- account structs ----------------------------------------------------------------------------

# `\b` is looked for at a `p` only: it is dear, and most characters are none.
FIELD_HEAD = r"p(?<=\bp)ub\s+(\w+)\s*:\s*"
FIELD_TYPE = r"(?:[^,<>\n]++|<[^<>]*+(?:<[^<>]*+(?:<[^<>]*+>[^<>]*+)*+>[^<>]*+)*+>)++"
#: A field with the text since the last one, and a field alone as name and type.
FIELD = rf"[\s\S]*?{FIELD_HEAD}{FIELD_TYPE}"
DECLARED = rf"{FIELD_HEAD}+({FIELD_TYPE})"
#: Stands around the names and types of a body's fields, where it is cut.
CUT = "\u0000"


def account_type(t: Column) -> Column:
    """Class of an account field by its type text (blanks removed) and its type argument."""
    return (
        F.when(has(t, "Signer"), "Signer").when(has(t, "Program<"), "Program").when(has(t, "SystemAccount"), "SystemAccount")
        .when(has(t, "UncheckedAccount"), "UncheckedAccount").when(has(t, "AccountInfo"), "RawAccountInfo")
        .when(has(t, "TokenAccount"), "TokenAccount").when(has(t, "Mint") & ~has(t, "Account<"), "Mint")
        .when(has(t, "Mint") & has(type_argument(t), "Mint"), "Mint").when(has(t, "Account<"), "TypedAccount").otherwise("Unknown")
    )


def type_argument(t: Column) -> Column:
    arg = F.regexp_extract(t, r",(.*)>[^>]*$", 1)
    return F.when(~has(t, ","), t).when(arg == "", t).otherwise(F.trim(arg))


# Kinds of constraints and the token of an attribute that makes each.
PLAIN_KINDS = {"Mutable": "mut", "SignerConstraint": "signer", "Init": "init"}
RAW_KINDS = {"Seeds": "seeds", "CustomConstraint": "constraint", "Address": "address", "Owner": "owner", "Close": "close"}
VALUE_KINDS = {"HasOne": ("has_one", "has_one"), "TokenMint": ("token::mint", "mint"), "TokenAuthority": ("token::authority", "authority")}
KIND_TOKENS = PLAIN_KINDS | RAW_KINDS | {k: token for k, (token, _) in VALUE_KINDS.items()}


def _value(attr: Column, kind: str) -> Column:
    return F.regexp_extract(attr, rf"{VALUE_KINDS[kind][1]}\s*=\s*(\w+)", 1)


def _constraints(attr: Column) -> Column:
    make = lambda kind, arg, text: F.when(has(attr, KIND_TOKENS[kind]), F.struct(F.lit(kind).alias("kind"), arg.alias("arg"), text.alias("raw")))
    parts = [make(k, F.lit(""), F.lit(t)) for k, t in PLAIN_KINDS.items()]
    parts += [make(k, F.lit(""), attr) for k in RAW_KINDS]
    parts += [make(k, _value(attr, k), attr) for k in VALUE_KINDS]
    return F.array_compact(F.array(*parts))


def _field_name(piece: Column) -> Column:
    return F.regexp_extract(piece, FIELD_HEAD, 1)


def _field_type(piece: Column) -> Column:
    return F.replace(F.regexp_extract(piece, FIELD_HEAD + r"([\s\S]*)$", 2), F.lit(" "), F.lit(""))


def _field_parts(x: Column, i: Column) -> Column:
    return F.struct(
        i.alias("pos"), _field_name(x).alias("name"), _field_type(x).alias("type_text"), F.regexp_extract(x, r"^([\s\S]*?)" + FIELD_HEAD, 1).alias("lead"))


def attribute(lead: Column) -> Column:
    """What stands before a field, without line comments. A token in it is in the lead, too."""
    return F.trim(F.when(has(lead, "//"), F.regexp_replace(lead, r"//[^\n]*", "")).otherwise(lead))


def _field_attribute(x: Column) -> Column:
    return F.struct(x["pos"], x["name"], x["type_text"], has(x["lead"], "CHECK").alias("has_check"), attribute(x["lead"]).alias("attr"))


def is_signer(kind: Column, attr: Column) -> Column:
    return has(kind, "Signer") | has(attr, KIND_TOKENS["SignerConstraint"])


def _field_class(x: Column) -> Column:
    return F.struct(
        x["pos"], x["name"], x["type_text"], account_type(x["type_text"]).alias("account_type"), type_argument(x["type_text"]).alias("type_arg"),
        _constraints(x["attr"]).alias("constraints"), has(x["attr"], KIND_TOKENS["Mutable"]).alias("is_mutable"),
        is_signer(x["type_text"], x["attr"]).alias("is_signer"), x["has_check"], x["attr"])


#: A field is read in steps, each of which takes finished values from the one before.
FIELD_STEPS = (_field_attribute, _field_class)


def _field_pieces(structs: DataFrame, keep: list[str], body: str) -> DataFrame:
    """keep and `fields`: each field's pos, name, type_text and lead (the text since the last field), found for all fields of a body at once."""
    text, cut = F.col(body), F.col("_cut")
    marked = F.regexp_replace(text, DECLARED, f"{CUT}$1{CUT}$2{CUT}")
    # a lead with the head of a field without a type takes that head's name: such bodies, and those with a mark, are read piece by piece
    odd = has(text, CUT) | has(F.col("_marked"), "pub") & F.col("_marked").rlike(r"p(?<=\bp)ub\s+\w+\s*:")
    rows = structs.select("*", marked.alias("_marked"))
    rows = rows.select(*keep, F.when(odd, F.regexp_extract_all(text, F.lit(FIELD), F.lit(0))).alias("_odd"), F.split("_marked", CUT, -1).alias("_cut"))

    def declared(name, i):
        return F.struct(
            i.alias("pos"), name.alias("name"), F.replace(F.get(cut, 3 * i + 2), F.lit(" "), F.lit("")).alias("type_text"), F.get(cut, 3 * i).alias("lead"))

    names = F.filter(cut, lambda x, i: i % 3 == 1)
    return rows.select(*keep, F.when(F.col("_odd").isNull(), F.transform(names, declared)).otherwise(F.transform("_odd", _field_parts)).alias("fields"))


def with_fields(structs: DataFrame, body: str = "body") -> DataFrame:
    """Add `fields`: the struct's account fields as one array, so later checks stay inside the row."""
    rows = _field_pieces(structs, structs.columns, body)
    for step in FIELD_STEPS:
        rows = rows.withColumn("fields", F.transform("fields", step))
    return rows


def inline_found(rows: DataFrame, keys: list[str], found: Column) -> DataFrame:
    """One row for each struct of an array, nulls left out. An inner generator on a column puts a filter by the array's size in
    front, which makes the array a second time, and a function on the array would have its tests interpreted."""
    rows = rows.select(*keys, found.alias("_found")).select(*keys, F.explode_outer("_found").alias("_f")).filter("_f is not null")
    return rows.select(*keys, "_f.*")


def each_field(structs: DataFrame, keys: list[str], body: str = "body") -> tuple[DataFrame, dict[str, Column]]:
    """(rows, columns): one row per field with its struct's `fields` as _field_pieces has them, and the columns of the field."""
    rows = _field_pieces(structs, keys, body).select(*keys, "fields", F.explode_outer("fields").alias("_f")).filter("_f is not null")
    f = {n: F.col("_f")[n] for n in ("pos", "name", "type_text", "lead")}
    for more in (
        {"has_check": has(f["lead"], "CHECK"), "attr": attribute(f["lead"])},
        {"account_type": account_type(f["type_text"]), "is_mutable": has(F.col("_attr"), KIND_TOKENS["Mutable"]),
         "is_signer": is_signer(f["type_text"], F.col("_attr"))},
    ):
        rows = rows.select("*", *[c.alias(f"_{n}") for n, c in more.items()])
        f |= {n: F.col(f"_{n}") for n in more}
    return rows, f


def account_fields(structs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """One row per account field."""
    rows, f = each_field(structs, keys, body)
    parts = f | {"type_arg": type_argument(f["type_text"]), "constraints": _constraints(f["attr"])}
    order = ("pos", "name", "type_text", "account_type", "type_arg", "constraints", "is_mutable", "is_signer", "has_check", "attr")
    return rows.select(*keys, *[parts[n].alias(n) for n in order])


def account_schemas(structs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Struct name and map of field name to type; the last declaration of a name wins."""
    rows = _field_pieces(structs, keys, body).withColumn("_f", F.transform("fields", lambda f: F.struct(f["name"], f["type_text"])))
    rows = rows.withColumn("_n", F.transform("_f", lambda f: f["name"]))
    last = F.filter("_f", lambda f, i: ~F.array_contains(F.slice("_n", i + 2, F.size("_n")), f["name"]))
    return rows.select(*keys, F.map_from_entries(last).alias("schema"))


def has_kind(field, *kinds):
    """The field has a constraint of one of the kinds."""
    return has_any(field["attr"], [KIND_TOKENS[k] for k in kinds])


def points_at(field, name):
    """The field's has_one names the other field."""
    return has_kind(field, "HasOne") & (_value(field["attr"], "HasOne") == name)


def piece_has(piece, kind):
    """has_kind of a field that still has its lead."""
    return has(piece["lead"], KIND_TOKENS[kind]) & has(attribute(piece["lead"]), KIND_TOKENS[kind])


def piece_points_at(piece, name):
    """points_at of a field that still has its lead."""
    return piece_has(piece, "HasOne") & (_value(attribute(piece["lead"]), "HasOne") == name)


def any_signer(fields):
    return F.exists(fields, lambda o: has(o["type_text"], "Signer") | piece_has(o, "SignerConstraint"))


AUTHORITY_PARTS = ("authority", "admin", "owner")


def aliasing_findings(structs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Field checks of an account struct: ALIAS-02 .. ALIAS-05, one row per (field, rule)."""
    rows, f = each_field(structs, keys, body)
    fields, name, kind = F.col("fields"), f["name"], f["account_type"]
    linked = F.exists(fields, lambda o: piece_points_at(o, name) & (o["name"] != name))
    close_target = F.exists(fields, lambda o: piece_has(o, "Close") & F.contains(attribute(o["lead"]), name))
    raw = (kind == "RawAccountInfo") & ~f["has_check"] & ~has_kind(f, "HasOne", "Seeds", "Address", "Owner", "CustomConstraint", "Close") & ~linked
    unchecked = (kind == "UncheckedAccount") & ~f["has_check"]
    token = (kind == "TokenAccount") & ~has_kind(f, "Seeds", "HasOne", "TokenAuthority", "TokenMint")
    named = ~f["is_signer"] & has_any(F.lower(name), AUTHORITY_PARTS)
    excused = has_kind(f, "Address", "Seeds") | (linked & (any_signer(fields) | close_target))
    tests = (("SOL-ALIAS-02", raw, 4, 72), ("SOL-ALIAS-03", unchecked, 4, 80), ("SOL-ALIAS-04", token, 5, 75),
             ("SOL-ALIAS-05", named & ~excused, 5, 78))
    found = F.array(*[
        F.when(cond, F.struct(F.lit(i).alias("id"), name.alias("field"), F.lit(s).alias("severity"), F.lit(c).alias("confidence")))
        for i, cond, s, c in tests])
    return inline_found(rows, keys, found)


def _compatible(a, b):
    wild = lambda f: f["account_type"].isin("RawAccountInfo", "UncheckedAccount")
    typed = (a["account_type"] == "TypedAccount") & (b["account_type"] == "TypedAccount") & (a["type_arg"] == b["type_arg"])
    same = (a["account_type"] == b["account_type"]) & a["account_type"].isin("TokenAccount", "Mint")
    return wild(a) | wild(b) | typed | same


def alias_pairs(structs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """ALIAS-01: pairs of one struct's fields that may be the same account. A struct is one source row,
    so its pairs never leave the row; for tables of fields use `alias_counts`."""
    def distinct_by_rule(a, b):
        return has_kind(a, "CustomConstraint") & F.contains(a["attr"], b["name"]) & has(a["attr"], "!=")

    def pair(a, b):
        risky = (
            (a["pos"] < b["pos"]) & (a["is_mutable"] | b["is_mutable"]) & _compatible(a, b) & ~has_kind(a, "Seeds") & ~has_kind(b, "Seeds")
            & ~points_at(a, b["name"]) & ~points_at(b, a["name"]) & ~distinct_by_rule(a, b) & ~distinct_by_rule(b, a)
        )
        return F.when(risky, F.struct(
            a["name"].alias("account_a"), b["name"].alias("account_b"),
            F.when(a["is_mutable"] & b["is_mutable"], 5).otherwise(4).alias("severity")))

    pairs = lambda fields: F.flatten(F.transform(fields, lambda a: F.array_compact(F.transform(fields, lambda b: pair(a, b)))))
    return inline_found(with_fields(structs, body), keys, pairs(F.col("fields")))


def alias_counts(fields: DataFrame, links: DataFrame, group: str = "group", field: str = "field") -> DataFrame:
    """Exact numbers of risky pairs per group of fields, without forming the pairs.

    fields: group, field (unique in the group), kind ('any' matches every kind, null only 'any'),
    is_mutable, is_seeded. links: group, a, b - pairs that are linked or known to be distinct.
    Pairs are counted from per-kind counts; linked pairs are looked up and taken off.
    """
    free = fields.filter("not is_seeded")
    m, n = F.col("is_mutable").cast("bigint"), (~F.col("is_mutable")).cast("bigint")
    per_kind = free.groupBy(group, "kind").agg(F.sum(m).alias("m"), F.sum(n).alias("n"))
    any_kind = F.coalesce(F.col("kind") == "any", F.lit(False))
    own = F.col("kind").isNotNull()
    two = lambda c: (c * (c - 1) / 2).cast("bigint")
    totals = per_kind.groupBy(group).agg(
        F.coalesce(F.sum(F.when(any_kind, F.col("m"))), F.lit(0)).alias("wm"), F.coalesce(F.sum(F.when(any_kind, F.col("n"))), F.lit(0)).alias("wn"),
        F.coalesce(F.sum(F.when(~any_kind, F.col("m"))), F.lit(0)).alias("om"), F.coalesce(F.sum(F.when(~any_kind, F.col("n"))), F.lit(0)).alias("on"),
        F.coalesce(F.sum(F.when(~any_kind & own, two(F.col("m")))), F.lit(0)).alias("mm"),
        F.coalesce(F.sum(F.when(~any_kind & own, F.col("m") * F.col("n"))), F.lit(0)).alias("mn"),
    )
    both = two(F.col("wm")) + F.col("wm") * F.col("om") + F.col("mm")
    one = F.col("wm") * F.col("wn") + F.col("wm") * F.col("on") + F.col("wn") * F.col("om") + F.col("mn")
    pairs = totals.select(group, both.alias("_both"), one.alias("_one"))
    ends = links.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    end = lambda s: free.select(group, F.col(field).alias(s), F.col("kind").alias(f"k{s}"), F.col("is_mutable").alias(f"m{s}"))
    known = ends.join(end("a"), [group, "a"]).join(end("b"), [group, "b"])
    meets = (F.coalesce(F.col("ka") == "any", F.lit(False)) | F.coalesce(F.col("kb") == "any", F.lit(False)) | F.coalesce(F.col("ka") == F.col("kb"), F.lit(False)))
    off = known.filter(meets).groupBy(group).agg(
        F.count_if(F.col("ma") & F.col("mb")).alias("_xb"), F.count_if(F.col("ma") != F.col("mb")).alias("_xo"))
    out = pairs.join(off, group, "left").fillna(0, ["_xb", "_xo"])
    return out.select(group, (F.col("_both") - F.col("_xb")).alias("both_mutable"), (F.col("_one") - F.col("_xo")).alias("one_mutable"))


def effects_after_calls(blocks: DataFrame, key: str = "fn", order: str = "block", bucket: Column | None = None) -> DataFrame:
    """Effects that come after a call in the same function: the first call and how many came before.

    blocks: key, order, is_call, is_effect. One row per effect stands for all its (call, effect) pairs.
    """
    first = blocks.filter("is_call").groupBy(key).agg(F.min(order).alias("first_call"))
    counted = running_total(blocks, key, [order], F.col("is_call").cast("bigint"), bucket if bucket is not None else F.lit(0), "_calls")
    effects = counted.filter("is_effect").join(first, key).filter(F.col(order) > F.col("first_call"))
    before = F.col("_calls") - F.col("is_call").cast("bigint")
    return effects.select(key, order, "first_call", before.alias("n_calls_before"))
