"""Further rule packs over units, files and lines.

Fixed values: ids, severities, confidences, trigger tokens, patterns, costs and package names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import has_any, hits, line_array, line_count, occurrences, package_from_path
from auditlake.rules.engine import condition, condition_sql, emit, every, line, lower, none, regex, rule, scan_rules, some, within

# --- value protocols ----------------------------------------------------------------------------

DEFI = [
    rule("SOL-DEFI-01", "Price Oracle Without Staleness Check", 5, base=80, category="Oracle", cwe="CWE-829", when=every(
        some("get_price", "price_feed", line(every("oracle", "data")), "pyth", "switchboard", "chainlink"),
        none("last_update", "staleness", "max_age", "valid_slot", line(every("current_slot", "publish_slot")),
             line(every("Clock", "unix_timestamp"))))),
    rule("SOL-DEFI-02", "Flash-Loan Manipulable Value Calculation", 5, base=70, category="Flash Loan", cwe="CWE-682", when=every(
        some("get_balance", "lamports()", "token_amount", line(every("reserve", some("amount", "balance")))),
        line(every(some("/", "*"), some("price", "rate", "value", "share"))),
        none("reentrancy_guard", "flash_loan_guard", "no_reentrant", "locked", "twap", "time_weighted"))),
    rule("SOL-DEFI-03", "Swap Without Slippage Protection", 4, base=78, category="MEV", cwe="CWE-20", when=every(
        within("fn_name", some("swap", "exchange", "trade")), some("*", "/"),
        none("minimum_amount_out", "min_out", "slippage", "min_amount", "expected_amount",
             line(every("require!", ">", some("amount_out", "output")))))),
    rule("SOL-DEFI-04", "Liquidity Operation Without Deadline", 3, base=65, category="MEV", cwe="CWE-367", when=every(
        within("fn_name", some("add_liquidity", "remove_liquidity", "deposit", "withdraw")),
        none("deadline", "expiry", "max_slot", "valid_until"))),
    rule("SOL-DEFI-05", "Single Oracle Observation for Critical Decision", 4, base=68, category="Oracle", cwe="CWE-327", when=line(every(
        some("price", "oracle"), none("twap", "time_weighted", "observations", "cumulative"), some("get_", "fetch", "load"),
        some("collateral", "liquidat", "borrow", "health")))),
    rule("SOL-DEFI-06", "Rounding Direction Exploitation", 3, base=60, category="Arithmetic", cwe="CWE-682", when=every(
        within("fn_name", some("deposit", "mint", "withdraw", "redeem", "calculate_share")),
        line(every("/", some("share", "rate", "ratio"), none("checked_div", "ceil", "round_up"))))),
]

PROTOCOL_FIELDS = {
    "amm": ((3, "reserve"), (2, "liquidity|lp_supply"), (2, "swap_fee|trade_fee"), (3, "constant_product|invariant")),
    "lending": ((3, "collateral"), (2, "borrow|debt"), (2, "interest_rate|utilization"), (3, "health_factor|ltv")),
    "staking": ((3, "staked|stake_amount"), (2, "reward_per_token|emission_rate")),
    "aggregator": (),
    "token": ((1, "^mint$|^supply$|decimals"),),
}
PROTOCOL_FUNCTIONS = {
    "amm": ((3, ("swap", "exchange", "trade")), (2, ("add_liquidity", "remove_liquidity", "deposit_liquidity"))),
    "lending": ((3, ("borrow", "repay", "liquidate")), (2, ("deposit_collateral", "withdraw_collateral"))),
    "staking": ((3, ("stake", "unstake", "claim_rewards")),),
    "aggregator": ((3, ("route", "aggregate", "multi_hop")),),
    "token": ((1, ("mint_to", "burn", "transfer")),),
}
PROTOCOL_NAMES = {"amm": "Amm", "lending": "Lending", "staking": "Staking", "aggregator": "Aggregator", "token": "Token"}


def classify_protocol(fields: DataFrame, functions: DataFrame, by: str) -> DataFrame:
    """Protocol type from field and function names; ties go to the earlier type of the table.

    fields: by, struct_name, name; functions: by, fn_name. A struct scores a signal once.
    """
    name = F.col("name")
    struct_score = fields.groupBy(by, "struct_name").agg(*[
        sum((F.max(name.rlike(p).cast("int")) * w for w, p in signals), F.lit(0)).alias(kind) for kind, signals in PROTOCOL_FIELDS.items()
    ])
    fn = F.col("fn_name")
    fn_score = functions.select(by, *[
        sum((F.when(fn.isin(*names), w).otherwise(0) for w, names in signals), F.lit(0)).alias(kind)
        for kind, signals in PROTOCOL_FUNCTIONS.items()
    ])
    kinds = list(PROTOCOL_NAMES)
    total = struct_score.select(by, *kinds).unionByName(fn_score).groupBy(by).agg(*[F.sum(k).alias(k) for k in kinds])
    top = F.greatest(*kinds)
    kind = F.lit("Unknown")
    for k in reversed(kinds):
        kind = F.when(F.col(k) == top, PROTOCOL_NAMES[k]).otherwise(kind)
    return total.select(by, *kinds, F.when(top == 0, "Unknown").otherwise(kind).alias("protocol"))


# --- unsafe code --------------------------------------------------------------------------------

#: (id, category, severity with no comment, severity with a SAFETY comment, line pattern)
UNSAFE_LINES = (
    ("unsafe_block", "UnsafeBlock", "High", "Medium", r"\bunsafe\s*\{"),
    ("unsafe_fn", "UnsafeFunction", "High", "Medium", r"\bunsafe\s+(?:extern\s+\"\w+\"\s+)?fn\s"),
    ("unsafe_impl", "UnsafeTrait", "High", "High", r"\bunsafe\s+impl\b"),
    ("union", "UnionType", "High", "High", r"^\s*(?:pub\s+)?union\s+\w+"),
    ("asm", "InlineAssembly", "Critical", "Critical", r"\b(?:global_)?asm!\s*[({\[]"),
    ("extern_block", "FFICall", "Critical", "Critical", r"\bextern\s+\"\w+\"\s*\{"),
    ("no_mangle", "FFICall", "Critical", "Critical", r"#\[no_mangle\]"),
    ("extern_fn", "FFICall", "High", "High", r"\bextern\s+\"\w+\"\s+fn\s"),
    ("link", "FFICall", "High", "High", r"#\[link(?:\(|_name)"),
    ("const_ptr", "RawPointer", "High", "High", r"\*const\s+\w+"),
    ("mut_ptr", "RawPointer", "Critical", "Critical", r"\*mut\s+\w+"),
    ("as_ptr", "RawPointer", "Medium", "Medium", r"\.as_ptr\(\)"),
    ("as_mut_ptr", "RawPointer", "High", "High", r"\.as_mut_ptr\(\)"),
    ("offset", "RawPointer", "Critical", "Critical", r"\.offset\("),
    ("ptr_add", "RawPointer", "High", "High", r"\.add\("),
    ("from_raw_parts", "RawPointer", "Critical", "Critical", r"from_raw_parts(?:_mut)?\("),
    ("null", "RawPointer", "Medium", "Medium", r"null\(\)|null_mut\(\)"),
    ("ptr_read", "UnsafeDeref", "High", "High", r"ptr::read(?:_volatile)?\("),
    ("ptr_write", "UnsafeDeref", "Critical", "Critical", r"ptr::write(?:_volatile)?\("),
    ("transmute", "TransmuteCall", "Critical", "Critical", r"transmute\s*[:<(]"),
    ("transmute_copy", "TransmuteCall", "Critical", "Critical", r"transmute_copy\s*[:<(]"),
    ("assume_init", "TransmuteCall", "Critical", "Critical", r"assume_init\s*\("),
    ("from_raw", "TransmuteCall", "High", "High", r"from_raw\s*\("),
    ("into_raw", "TransmuteCall", "Medium", "Medium", r"into_raw\s*\("),
    ("zeroed_init", "TransmuteCall", "High", "High", r"zeroed\s*\(\)\s*\.\s*assume_init"),
    ("ptr_cast", "TransmuteCall", "High", "High", r"\bas\s+\*(?:const|mut)\s"),
)
#: Every unsafe pattern needs one of these.
UNSAFE_TOKENS = ("unsafe", "union", "asm!", "extern", "#[no_mangle]", "#[link", "*const", "*mut", "_ptr(", ".offset(", ".add(", "from_raw",
                 "null", "ptr::", "transmute", "assume_init", "into_raw", "zeroed")
UNSAFE_CALLS = ("invoke", "sol_memcpy", "sol_memset", "AccountInfo", "from_raw_parts")


def scan_line_patterns(
    files: DataFrame, patterns, text: str = "content", keep: list[str] | None = None, tokens=()
) -> DataFrame:
    """Line findings of (id, category, severity, severity when documented, pattern).

    tokens: texts and lines without any of them are skipped. A line is first tested against all patterns at once;
    the SAFETY comment is looked up in the three lines above, in the file's own row.
    """
    keep = keep or [c for c in files.columns if c != text]
    lines = F.col("_lines")
    rows = files.select(*keep, line_array(F.col(text)).alias("_lines"), F.col(text).alias("_text"))
    if tokens:
        rows = rows.filter(has_any(F.col("_text"), tokens))
    exploded = rows.select(*keep, "_lines", F.posexplode("_lines").alias("_i", "line"))
    code = F.trim("line")
    exploded = exploded.filter(~code.startswith("//") & ~code.startswith("/*") & ~code.startswith("*"))
    if tokens:
        exploded = exploded.filter(has_any(F.col("line"), tokens))
    exploded = exploded.filter(F.col("line").rlike("|".join(f"(?:{p[4]})" for p in patterns)))
    above = F.slice(lines, F.greatest(F.col("_i") - 2, F.lit(1)), F.least(F.col("_i"), F.lit(3)))
    documented = (F.col("_i") > 0) & F.exists(above, lambda x: F.trim(x).rlike("^///? SAFETY:"))
    exploded = exploded.select(*keep, "_i", "line", documented.alias("_documented"))
    tests = [
        F.when(F.col("line").rlike(p), F.struct(
            F.lit(i).alias("id"), F.lit(c).alias("category"),
            (F.lit(s1) if s1 == s2 else F.when(F.col("_documented"), s2).otherwise(s1)).alias("severity")))
        for i, c, s1, s2, p in patterns
    ]
    return emit(exploded, [*keep, (F.col("_i") + 1).alias("line_no"), "line"], tests, "id")


def scan_unsafe(files: DataFrame, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Unsafe constructs; a block that touches program memory is one step worse."""
    out = scan_line_patterns(files, UNSAFE_LINES, text, keep, UNSAFE_TOKENS)
    worse = (F.col("id") == "unsafe_block") & has_any(F.col("line"), UNSAFE_CALLS)
    raised = F.when(F.col("severity") == "High", "Critical").otherwise("High")
    return out.withColumn("severity", F.when(worse, raised).otherwise(F.col("severity")))


UNSAFE_COUNTS = {
    "unsafe_blocks": r"\bunsafe\s*\{", "unsafe_functions": r"\bunsafe\s+fn\s", "unsafe_traits": r"\bunsafe\s+(?:impl|trait)\b",
    "ffi_calls": r"\bextern\s+\"\w+\"", "raw_pointers": r"\*(?:const|mut)\s+\w+", "transmute_calls": r"transmute\s*[:<(]",
    "asm_blocks": r"\basm!\s*[({\[]",
}


def unsafe_metrics(files: DataFrame, by: list[str], text: str = "content") -> DataFrame:
    """Construct counts and lines per group, ready for the unsafe-code score."""
    col = F.col(text)
    per = files.select(*by, line_count(col).alias("total_lines"), *[F.regexp_count(col, F.lit(p)).alias(n) for n, p in UNSAFE_COUNTS.items()])
    return per.groupBy(*by).agg(F.sum("total_lines").alias("total_lines"), *[F.sum(n).alias(n) for n in UNSAFE_COUNTS])


# --- arithmetic ---------------------------------------------------------------------------------

ARITHMETIC = (
    ("UncheckedArithmetic", 9, r"[\w)\]] [+\-] [\w(]"),
    ("PotentialDivisionByZero", 9, r" / [a-z_]\w*"),
    ("DivisionBeforeMultiplication", 7, r" / [^;]* \* "),
    ("IntegerCastingRisk", 7, r"\bas (?:u8|u16|u32|u64|i8|i16|i32|i64)\b"),
    ("ShiftOverflow", 6, r"<< [a-z_]\w*|>> [a-z_]\w*"),
    ("PotentialPrecisionLoss", 5, r" / \d{2,}"),
    ("ModuloByZero", 4, r" % [a-z_]\w*"),
)
#: Every arithmetic pattern needs one of these, and every checked call one of the parts.
ARITHMETIC_TOKENS = (" + ", " - ", " / ", "as ", "<< ", ">> ", " % ")
CHECKED_PARTS = ("checked_", "saturating_")
CHECKED_CALLS = ("checked_add", "checked_sub", "checked_mul", "checked_div", "saturating_add", "saturating_sub", "saturating_mul")


def scan_arithmetic(files: DataFrame, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Arithmetic issues per line; files that use checked math twice or more keep their bare sums."""
    keep = keep or [c for c in files.columns if c != text]
    col = F.col(text)
    used = sum((occurrences(col, t) for t in CHECKED_CALLS), F.lit(0))
    checked = F.when(has_any(col, CHECKED_PARTS), used >= 2).otherwise(F.lit(False))
    lines = files.select(*keep, checked.alias("_ok"), F.posexplode(line_array(col)).alias("_i", "line"))
    code = F.trim("line")
    lines = lines.filter((code != "") & ~code.startswith("//") & has_any(F.col("line"), ARITHMETIC_TOKENS) & ~has_any(F.col("line"), CHECKED_PARTS))
    tests = [
        F.when(F.col("line").rlike(p) & (~F.col("_ok") if kind == "UncheckedArithmetic" else F.lit(True)),
               F.struct(F.lit(kind).alias("kind"), F.lit(s).alias("cvss")))
        for kind, s, p in ARITHMETIC
    ]
    return emit(lines, [*keep, (F.col("_i") + 1).alias("line_no"), "line"], tests, "kind")


# --- boolean feature and safety checks ----------------------------------------------------------

ARITHMETIC_CALLS = some("checked_add", "checked_sub", "checked_mul", "checked_div", "saturating_add", "saturating_sub",
                        "saturating_mul", "overflowing_add", "overflowing_sub")
FEATURES = {
    "unchecked_arithmetic": every(some(" + ", " - ", " * ", " / ", "+= ", "-= ", "*= ", "/= "), none(ARITHMETIC_CALLS)),
    "checked_arithmetic": ARITHMETIC_CALLS,
    "signer_check": some("is_signer", "Signer", "has_one", "constraint", "require_keys_eq!", "account(signer", "authority", ".key()"),
    "owner_check": some("owner", "Owner", "has_one", "constraint", "Account<"),
    "pda_check": some("find_program_address", "create_program_address", "seeds =", "bump =", "account(seeds"),
}


def feature_flags(df: DataFrame, text: str = "content", keep: list[str] | None = None, features=FEATURES) -> DataFrame:
    keep = keep or [c for c in df.columns if c != text]
    return df.select(*keep, *[condition(t, text).alias(n) for n, t in features.items()])


SAFETY_CHECKS = [
    rule("SAFE-OVERFLOW", "Arithmetic without overflow checks", 4, when=FEATURES["unchecked_arithmetic"]),
    rule("SAFE-REENTRANCY", "State written after a call", 5, when=regex(r"(?s)invoke.*(?:borrow_mut|serialize)")),
    rule("SAFE-ACCESS", "Mutation without access control", 5, when=every(
        some("borrow_mut", "&mut "), none("Signer", "is_signer", "has_one", "require!"))),
    rule("SAFE-ORACLE", "Oracle data without freshness check", 4, when=every(
        some("oracle", "price_feed", "get_price"), none("staleness", "last_update", "max_age", "publish_time"))),
]

EXPLOIT_LINES = (
    ("Wormhole Bridge", "MissingOwnerCheck", "Critical", "Critical", r"verify_signatures.*guardian.*without.*owner.*check"),
    ("Cashio Stablecoin", "AccountConfusion", "Critical", "Critical", r"mint_authority.*AccountInfo.*!.*Account<"),
    ("Saber Swap", "IntegerOverflow", "Critical", "Critical", r"amount.*\+.*fee.*without.*checked"),
    ("Crema Finance", "ComplexReentrancy", "Critical", "Critical", r"flash_loan.*callback.*without.*reentrancy.*guard"),
)

BINARY_RISKS = [
    rule("BIN-OVERFLOW", "Unchecked cast of a value", 4, category="IntegerOverflow", cwe="CWE-190", when=every(
        "as u64", some("amount", "balance", "lamports"), none("checked_", "saturating_"))),
    rule("BIN-UNINIT", "Deserialization without initialization check", 4, category="UninitializedData", cwe="CWE-908", when=every(
        some("try_from_slice", "unpack"), none("validate", "is_initialized"))),
    rule("BIN-MEMORY", "Memory operation without bounds", 5, category="MemorySafety", cwe="CWE-787", when=every(
        some("unsafe", "ptr::"), some("copy", "write_bytes", "read_unaligned"), none("len()", "bounds"))),
    rule("BIN-REENTRANCY", "Call followed by state write", 4, category="ReentrancyPattern", cwe="CWE-841", when=every(
        "program_id", none("reentrancy", "is_locked", "guard"), regex(r"(?s)invoke.*(?:serialize|pack_into|borrow_mut)"))),
    rule("BIN-EXTERNAL", "Outside data copied unchecked", 4, category="UncheckedExternalData", cwe="CWE-20", when=every(
        some("account_info", "AccountInfo"), "data", some("memcpy", "copy_from_slice"), none("check", "validate"))),
]

CALL_RISKS = [
    rule("CPI-ARBITRARY", "Call without target validation", 5, category="ArbitraryCPI", when=every(
        some("invoke(", "invoke_signed("), none("program_id", "key()", "require_keys_eq", "constraint =", "Program<"))),
    rule("CPI-UNTYPED", "Call context from an untyped account", 4, category="PrivilegeEscalation", when=every(
        some("CpiContext", "cpi::"), "AccountInfo", none("Program<"))),
    rule("CPI-SIGNER", "Signer forwarded without validation", 4, category="PrivilegeEscalation", when=every(
        some("invoke(", "invoke_signed("), "is_signer", none("require!"))),
]

# --- mined invariants ---------------------------------------------------------------------------

CHECKED_USE = some("checked_add", "checked_sub", "checked_mul", "checked_div", "saturating_add", "saturating_sub")
#: (prefix, category, condition, expression, confidence, counterexample or None)
INVARIANTS = (
    ("BC", "BalanceConservation", every("transfer", some("from", "to")), "from.balance + to.balance == TOTAL_BEFORE", 0.9, None),
    ("BC", "BalanceConservation", some("withdraw", "redeem"), "withdraw_amount <= account.balance", 0.95, None),
    ("BC", "BalanceConservation", some("deposit", "stake"), "balance_after >= balance_before", 0.85, None),
    ("AC", "AccessControl", every(some("authority", "owner"), "Signer<"), "msg.sender == account.authority", 0.95, None),
    ("AC", "AccessControl", every(some("authority", "owner"), none("Signer<")), "authority MUST BE Signer", 0.6,
     "Authority used without Signer constraint"),
    ("AR", "ArithmeticBounds", every(some("u64", "u128"), CHECKED_USE), "result in [0, u64::MAX]", 0.9, None),
    ("AR", "ArithmeticBounds", every(some("u64", "u128"), none(CHECKED_USE), some("+", "-", "*")),
     "result SHOULD BE in [0, u64::MAX]", 0.5, "Unchecked arithmetic detected"),
    ("ST", "StateTransition", "initialized", "initialized: false -> true (one-way)", 0.85, None),
    ("ST", "StateTransition", some("paused", "frozen"), "if paused then no_operations()", 0.8, None),
)


def mine_invariants(files: DataFrame, text: str = "content", keep: list[str] | None = None, table=INVARIANTS) -> DataFrame:
    """(invariant_id, category, expression, confidence, counterexample) per file; ids count within the file."""
    keep = keep or [c for c in files.columns if c != text]
    tests = [
        F.when(condition(t, text), F.struct(F.lit(p).alias("prefix"), F.lit(c).alias("category"), F.lit(e).alias("expression"),
                                                  F.lit(conf).alias("confidence"), F.lit(bad).cast("string").alias("counterexample")))
        for p, c, t, e, conf, bad in table
    ]
    rows = files.select(*keep, F.posexplode(F.array_compact(F.array(*tests))).alias("_i", "_v"))
    return rows.select(
        *keep, F.concat_ws("-", F.col("_v.prefix"), (F.col("_i") + 1).cast("string")).alias("invariant_id"), "_v.category", "_v.expression",
        "_v.confidence", "_v.counterexample",
    )


# --- scripts and packages -----------------------------------------------------------------------

KEY_ACCESS = ("secretKey", "Keypair.fromSecretKey", "Keypair.fromSeed", "process.env.PRIVATE", "process.env.SECRET",
              "process.env.SOLANA", ".solana/id.json")
NETWORK = ("fetch(", "axios", "http.request", "https.request", "XMLHttpRequest", "navigator.sendBeacon", ".postMessage(")
CLIPBOARD = ("clipboard", "writeText(", "readText(", "execCommand('copy'")
OBFUSCATION = ("\\x", "\\u00", "String.fromCharCode", "eval(", "Function(", "require('child_process')")
MAX_BUNDLE_LINES, MIN_BUNDLE_CHARS = 3, 10_000


def drop_minified(df: DataFrame, text: str = "content") -> DataFrame:
    """Leave out bundles: at most three lines and more than 10 000 characters."""
    col = F.col(text)
    return df.filter(~((line_count(col) <= MAX_BUNDLE_LINES) & (F.length(col) > MIN_BUNDLE_CHARS)))


def scan_behaviour(
    files: DataFrame, text: str = "content", path: str = "file_path", keep: list[str] | None = None, key_access=KEY_ACCESS,
    network=NETWORK, clipboard=CLIPBOARD, obfuscation=OBFUSCATION,
) -> DataFrame:
    """Key theft (ends the file's scan), clipboard hijacking and obfuscation in scripts."""
    keep = keep or [c for c in files.columns if c != text]
    col = F.col(text)
    theft = has_any(col, key_access) & has_any(col, network)
    make = lambda s, t: F.struct(F.lit(s).alias("severity"), F.lit("SuspiciousBehavior").alias("category"), F.lit(t).alias("title"))
    found = F.when(theft, F.array(make("Critical", "Key access with network call"))).otherwise(F.array_compact(F.array(
        F.when(hits(col, clipboard) >= 2, make("High", "Clipboard hijacking indicators")),
        F.when(hits(col, obfuscation) >= 3, make("Medium", "Heavily obfuscated code")))))
    kept = drop_minified(files, text)
    return kept.select(*keep, F.coalesce(package_from_path(F.col(path)), F.lit("unknown")).alias("package_name"), F.inline(found))


HOOKS = ("preinstall", "postinstall", "preuninstall")
SCRIPT_TOKENS = (
    "curl ", "wget ", "fetch(", "http://", "https://", "eval(", "exec(", "child_process", "spawn(", ".solana/id.json", "Keypair",
    "secretKey", "privateKey", "PRIVATE_KEY", "Buffer.from(", "atob(", "btoa(", "base64", "/bin/sh", "/bin/bash", "nc -e", "netcat",
)


def scan_hooks(scripts: DataFrame, name: str = "hook", text: str = "script", hooks=HOOKS, tokens=SCRIPT_TOKENS) -> DataFrame:
    """Lifecycle scripts with a suspicious token (case-insensitive)."""
    low = F.lower(text)
    bad = scripts.filter(F.col(name).isin(*hooks) & has_any(low, [t.lower() for t in tokens]))
    return bad.withColumns({"severity": F.lit("High"), "category": F.lit("SuspiciousBehavior")})


TRUSTED_ORGS = ("github.com/solana-labs", "github.com/coral-xyz", "github.com/metaplex-foundation", "github.com/project-serum",
                "github.com/anza-xyz")


def scan_dependency_sources(deps: DataFrame, path: str = "path", git: str = "git", trusted=TRUSTED_ORGS) -> DataFrame:
    """Deep relative paths (Medium) and git sources outside the trusted organisations (Low)."""
    deep = occurrences(F.col(path), "..") > 2
    foreign = F.contains(F.col(git), F.lit("github.com")) & ~has_any(F.col(git), trusted)
    make = lambda s, t: F.struct(F.lit(s).alias("severity"), F.lit("SuspiciousSource").alias("category"), F.lit(t).alias("title"))
    return deps.select("*", F.inline(F.array_compact(F.array(
        F.when(deep, make("Medium", "Deep path dependency")), F.when(foreign, make("Low", "Git dependency from another organisation"))))))


LEGIT_NPM = (
    "@solana/web3.js", "@solana/spl-token", "@solana/spl-account-compression", "@solana/spl-memo", "@solana/spl-name-service",
    "@solana/spl-stake-pool", "@solana/spl-token-lending", "@solana/spl-governance", "@solana/wallet-adapter-base",
    "@solana/wallet-adapter-react", "@solana/wallet-adapter-wallets", "@coral-xyz/anchor", "@coral-xyz/borsh",
    "@metaplex-foundation/mpl-token-metadata", "@metaplex-foundation/umi", "@metaplex-foundation/mpl-bubblegum",
    "@solana/pay", "@solana/buffer-layout", "@solana/spl-token-registry", "@project-serum/anchor", "@project-serum/serum",
    "@solflare-wallet/sdk", "@phantom/wallet-sdk", "@raydium-io/raydium-sdk", "@orca-so/whirlpools-sdk", "@jup-ag/core",
    "@jup-ag/api", "@marinade.finance/marinade-ts-sdk", "@switchboard-xyz/solana.js", "@pyth-network/client", "borsh",
    "bn.js", "bs58", "tweetnacl", "buffer-layout", "solana-bankrun",
)
LEGIT_CARGO = (
    "solana-sdk", "solana-program", "solana-client", "solana-cli", "solana-transaction-status", "solana-account-decoder",
    "solana-rpc", "solana-program-test", "solana-banks-client", "solana-clap-utils", "solana-logger", "solana-measure",
    "solana-metrics", "anchor-lang", "anchor-spl", "anchor-client", "anchor-syn", "spl-token", "spl-token-2022",
    "spl-associated-token-account", "spl-memo", "spl-name-service", "spl-stake-pool", "spl-governance", "mpl-token-metadata",
    "mpl-bubblegum", "pyth-sdk-solana", "switchboard-solana", "clockwork-sdk", "borsh", "bs58",
)

# --- runtime differences ------------------------------------------------------------------------

#: (id, title, severity, trigger tokens)
RUNTIME_DIFFS = (
    ("FD-001", "Compute Unit Metering Differences", "RISKY",
     ("sol_memcpy", "sol_memset", "sol_memmove", "sol_log", "msg!", "sol_log_data", "compute_budget", "ComputeBudget")),
    ("FD-002", "Transaction Ordering Non-Determinism", "BREAKING",
     ("slot_hashes", "recent_blockhashes", "SlotHashes", "RecentBlockhashes", "leader_schedule")),
    ("FD-003", "Clock Sysvar Resolution", "RISKY", ("Clock::get()", "unix_timestamp", "clock.unix_timestamp", "slot_duration")),
    ("FD-004", "Account Data Serialization Edge Cases", "RISKY",
     ("realloc", "data_len", "MAX_PERMITTED_DATA_LENGTH", "data.borrow_mut()", "try_borrow_mut_data")),
    ("FD-005", "CPI Depth and Stack Frame Differences", "RISKY", ("invoke(", "invoke_signed(", "CpiContext", "cpi::")),
    ("FD-006", "Sysvars Access Method Differences", "INFO", ("Sysvar::get()", "from_account_info", "Rent::get()", "EpochSchedule::get()")),
    ("FD-007", "Concurrent Account Access Scheduling", "BREAKING", ("AccountInfo", "try_borrow_mut", "RefMut", "borrow_mut")),
    ("FD-008", "Log Output Format Differences", "INFO", ("msg!", "sol_log", "emit!", "Program log:", "Program data:")),
)
#: (syscall, tokens, cost on the usual client, cost on the other client)
SYSCALLS = (
    ("sol_memcpy", ("sol_memcpy", "copy_from_slice", ".copy_within"), 10, 12),
    ("sol_memset", ("sol_memset", ".fill(0)", "data.fill("), 10, 11),
    ("sol_memmove", ("sol_memmove", "ptr::copy"), 10, 12),
    ("sol_log", ("msg!", "sol_log(", "sol_log_64"), 100, 100),
    ("sol_log_data", ("sol_log_data", "emit!", "sol_log_data("), 100, 105),
    ("sol_invoke_signed", ("invoke_signed(", "invoke(", "CpiContext::new"), 1000, 1000),
    ("sol_create_program_address", ("Pubkey::create_program_address", "find_program_address"), 1500, 1500),
    ("sol_sha256", ("sha256", "Sha256", "hashv("), 85, 90),
    ("sol_keccak256", ("keccak256", "Keccak256", "keccak::hash"), 85, 88),
    ("sol_secp256k1_recover", ("secp256k1_recover", "Secp256k1"), 25000, 25000),
    ("sol_get_clock_sysvar", ("Clock::get()", "clock::Clock"), 10, 10),
    ("sol_get_rent_sysvar", ("Rent::get()", "rent::Rent"), 10, 10),
)


def runtime_diffs(df: DataFrame, text: str = "content", keep: list[str] | None = None, table=RUNTIME_DIFFS) -> DataFrame:
    """Known runtime differences triggered by any of their tokens."""
    keep = keep or [c for c in df.columns if c != text]
    tests = [
        F.when(has_any(F.col(text), tokens), F.struct(F.lit(i).alias("id"), F.lit(t).alias("title"), F.lit(s).alias("severity")))
        for i, t, s, tokens in table
    ]
    return emit(df, keep, tests, "id")


def syscall_usage(df: DataFrame, text: str = "content", keep: list[str] | None = None, table=SYSCALLS) -> DataFrame:
    """First line of each syscall token per file, with both costs."""
    keep = keep or [c for c in df.columns if c != text]
    col = F.col(text)
    tests = []
    for name, tokens, cost, other in table:
        for token in tokens:
            before = F.substring_index(col, token, 1)
            line_no = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
            tests.append(F.when(F.contains(col, F.lit(token)), F.struct(
                F.lit(name).alias("syscall"), F.lit(token).alias("token"), line_no.alias("line_no"), F.lit(cost).alias("cu_cost"),
                F.lit(other).alias("cu_cost_other"), F.lit(cost != other).alias("has_diff"))))
    return emit(df, keep, tests, "syscall")


COMPATIBILITY = [
    rule("COMPAT-SLOT-HASHES", "TransactionOrderingDependency", 4, when=some("slot_hashes", "SlotHashes")),
    rule("COMPAT-BLOCKHASHES", "TransactionOrderingDependency", 4, when=some("recent_blockhashes", "RecentBlockhashes")),
    rule("COMPAT-CLOCK", "ClockResolutionAssumption", 3, when=every("unix_timestamp", some("+ 1", "+ 2", "+ 3"))),
    rule("COMPAT-CONCURRENT", "ConcurrentAccountAccess", 4, when=every(
        "try_borrow_mut_data", none("reentrancy", "lock", "mutex"))),
]
SAFE_PATTERNS = {
    "anchor_framework": "anchor_lang", "checked_math": some("checked_", "saturating_"), "account_constraints": "#[account(",
    "require_macros": some("require!", "require_keys_eq!"),
}


def compatibility_warnings(df: DataFrame, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """(kind, severity) warnings for the compatibility score: rules plus triggered differences."""
    keep = keep or [c for c in df.columns if c != text]
    rules = scan_rules(df, COMPATIBILITY, text, keep).select(*keep, F.col("vuln_type").alias("kind"), F.lit("").alias("severity"))
    diffs = runtime_diffs(df, text, keep).select(*keep, F.lit("RuntimeDifference").alias("kind"), "severity")
    return rules.unionByName(diffs)


def safe_patterns(df: DataFrame, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """(pattern) of each text: what it does that behaves alike on every runtime."""
    keep = keep or [c for c in df.columns if c != text]
    notes = [F.when(condition(tree, text), F.lit(name)) for name, tree in SAFE_PATTERNS.items()]
    return df.select(*keep, F.explode(F.array_compact(F.array(*notes))).alias("pattern"))


# --- account-safety packs on fields -------------------------------------------------------------

AUTHORITY_WORDS = ("authority", "admin", "owner", "governance", "governor", "payer", "creator", "manager", "operator", "multisig", "signer")
PRIVILEGED = (
    "authority", "admin", "owner", "manager", "operator", "governance", "guardian", "multisig", "payer", "fee_authority",
    "update_authority", "withdraw_authority", "close_authority", "freeze_authority", "mint_authority",
)
PDA_WORDS = ("pda", "vault", "pool", "config", "state", "escrow", "treasury")
RELATED = (("source", "dest"), ("from", "to"), ("sender", "receiver"), ("sender", "recipient"), ("input", "output"), ("user", "vault"),
           ("deposit", "withdraw"), ("token_a", "token_b"), ("base", "quote"), ("pool", "user"))
PROGRAM_FIELDS = ("system_program", "rent")


def account_safety(structs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Field checks: ownership, confusion, signer, derived address, close, framework constraints."""
    from auditlake.operators.code import any_signer, attribute, each_field, inline_found, piece_has, piece_points_at

    rows, f = each_field(structs, keys, body)
    fields, attr, name, kind = F.col("fields"), f["attr"], f["name"], f["account_type"]
    a = lambda t: F.contains(attr, F.lit(t))
    closing = lambda text: F.contains(text, F.lit("close")) & text.rlike(r"close\s*=")
    authority = lambda c: has_any(F.lower(c), AUTHORITY_WORDS)
    raw, unchecked = kind == "RawAccountInfo", kind == "UncheckedAccount"
    wild = raw | unchecked
    typed = kind.isin("TypedAccount", "TokenAccount") & F.contains(f["type_text"], F.lit("Account<"))
    privileged = name.isin(*PRIVILEGED) | F.contains(name, F.lit("_")) & name.rlike("_(?:" + "|".join(PRIVILEGED) + ")$")
    pda_name = has_any(name, PDA_WORDS)
    linked = F.exists(fields, lambda o: piece_points_at(o, name) & (o["name"] != name))
    any_close = F.exists(fields, lambda o: closing(attribute(o["lead"])))
    any_mut = F.exists(fields, lambda o: piece_has(o, "Mutable"))
    any_authority = F.exists(fields, lambda o: authority(o["name"]))
    # cheap parts of a test come first
    tests = (
        ("OWNER-01", raw & ~a("owner") & ~f["has_check"], "Critical"),
        ("OWNER-02", unchecked & ~a("owner") & ~f["has_check"], "High"),
        ("CONFUSION-01", raw & ~f["has_check"] & ~a("account("), "Critical"),
        ("CONFUSION-02", unchecked & ~f["has_check"], "High"),
        ("SIGNER-01", wild & ~f["is_signer"] & authority(name), "Critical"),
        ("PDA-01", a("seeds") & ~a("bump") & ~a("init"), "Medium"),
        ("PDA-02", a("seeds") & ~a('b"') & ~attr.rlike(r"seeds\s*=\s*\[[^\]]*,"), "High"),
        ("PDA-03", typed & ~a("seeds") & pda_name, "High"),
        ("CLOSE-01", a("init_if_needed"), "High"),
        ("CLOSE-02", closing(attr) & ~a("has_one") & ~a("constraint") & ~a("authority"), "High"),
        ("CLOSE-03", a("init_if_needed") & any_close, "Critical"),
        ("ANCHOR-OWNER", wild & F.contains(name, F.lit("account")) & ~F.contains(name, F.lit("system")) & ~a("owner"), "High"),
        ("ANCHOR-CONSTRAINT", a("constraint =") & ~a("@"), "Medium"),
        ("ANCHOR-SPACE", a("init") & ~a("init_if_needed") & ~a("space"), "High"),
        ("ANCHOR-REINIT", a("init_if_needed"), "Critical"),
        ("ANCHOR-CLOSE", a("close") & ~a("has_one"), "High"),
        ("ANCHOR-SIGNER", wild & ~a("signer") & privileged, "Critical"),
        ("ANCHOR-AUTHORITY", typed & ~f["is_signer"] & ~a("has_one") & privileged & ~linked, "High"),
        ("ANCHOR-BUMP", a("seeds") & ~a("bump"), "Critical"),
        ("ANCHOR-SEEDS", a("seeds") & a('b"') & ~attr.rlike(r"\.key\(\)|as_ref\(\)|\.to_le_bytes\(\)|&\["), "Medium"),
        ("ANCHOR-INIT-SEEDS", (kind == "TypedAccount") & a("init") & ~a("seeds"), "High"),
        ("ANCHOR-PROGRAM", wild & F.contains(name, F.lit("program")) & ~name.isin(*PROGRAM_FIELDS), "Critical"),
    )
    # a struct's own finding comes with its first field
    whole = F.when((f["pos"] == 0) & any_mut & ~any_signer(fields) & ~any_authority, F.struct(
        F.lit("SIGNER-02").alias("id"), F.lit("").alias("field"), F.lit("High").alias("severity")))
    found = F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(i).alias("id"), name.alias("field"), F.lit(s).alias("severity"))) for i, cond, s in tests], whole)
    return inline_found(rows, keys, found)


def related_names(a, b):
    """Names that belong together (source/dest, from/to, ...), or share a base with _a/_b or a number."""
    low_a, low_b = F.lower(a), F.lower(b)
    out = F.lit(False)
    for x, y in RELATED:
        out = out | (F.contains(low_a, F.lit(x)) & F.contains(low_b, F.lit(y))) | (F.contains(low_a, F.lit(y)) & F.contains(low_b, F.lit(x)))
    base = lambda c: F.regexp_replace(c, r"[ab0-9_]+$", "")
    return out | ((base(low_a) != "") & (base(low_a) == base(low_b)) & (low_a != low_b))


def duplicate_mutable(structs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Related mutable accounts of a struct without a check that they differ."""
    from auditlake.operators.code import KIND_TOKENS, _field_pieces, attribute, inline_found, piece_has

    fields = F.col("fields")
    said = F.array_join(F.transform(fields, lambda f: attribute(f["lead"])), " ")
    differs = lambda x, y: F.contains(said, F.concat(x["name"], F.lit(".key() != "), y["name"], F.lit(".key()")))

    def pair(a, b):
        risky = (a["pos"] < b["pos"]) & related_names(a["name"], b["name"]) & ~differs(a, b) & ~differs(b, a)
        return F.when(risky, F.struct(a["name"].alias("account_a"), b["name"].alias("account_b")))

    mutable = F.filter(fields, lambda f: piece_has(f, "Mutable") & has_any(f["type_text"], ("Account<", "AccountInfo", "UncheckedAccount<")))
    pairs = lambda some: F.flatten(F.transform(some, lambda a: F.array_compact(F.transform(some, lambda b: pair(a, b)))))
    # a pair has the token of mutable fields twice in its body, before each of the two
    twice = F.substring_index(body, KIND_TOKENS["Mutable"], 2) != F.col(body)
    # inside an array the mutable fields are a finished value that both loops read
    return inline_found(_field_pieces(structs.filter(twice), keys, body), keys, F.flatten(F.transform(F.array(mutable), pairs)))


#: Line events and the evidence that answers them within a window of lines before and after.
NEAR_CALL = {
    "event": some("invoke(", "invoke_signed(", "program::invoke"), "before": 10, "after": 5,
    "evidence": lower(some(every("require_keys_eq!", "program"), every("assert_eq!", "key()"), "program::id()", every("::id()", "assert"), "program<'info")),
}
NEAR_REMAINING = {
    "event": "remaining_accounts", "before": 5, "after": 15,
    "evidence": lower(some(every(".owner", some("require", "assert", "==")), "try_from(", "try_deserialize", "require_keys_eq!", "key() ==",
                           every("is_signer", "require"))),
}


def unanswered_lines(files: DataFrame, spec: dict, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Event lines without evidence from `before` lines above up to `after` lines below, within the file's row."""
    keep = keep or [c for c in files.columns if c != text]
    rows = files.filter(condition(spec["event"], text)).select(*keep, line_array(F.col(text)).alias("_lines"))
    rows = rows.select(*keep, "_lines", F.posexplode("_lines").alias("_i", "line"))
    code = F.trim("line")
    rows = rows.filter(condition(spec["event"], "line") & ~code.startswith("//"))
    start = F.greatest(F.col("_i") - spec["before"], F.lit(0))
    rows = rows.withColumn("_w", F.slice("_lines", start + 1, F.col("_i") + spec["after"] - start))
    answered = F.expr(f"exists(_w, x -> {condition_sql(spec['evidence'], 'x')})")
    return rows.filter(~answered).select(*keep, (F.col("_i") + 1).alias("line_no"), "line")


HOOK_RULES = [
    rule("HOOK-META", "Transfer hook without extra account metas", 4, when=every(
        some("TransferHook", "transfer_hook", "spl_transfer_hook"), regex(r"fn \w*(?:transfer_hook|execute|on_transfer)"),
        none("extra_account_meta", "ExtraAccountMeta"))),
    rule("HOOK-AUTHORITY", "Transfer hook changes state without authority check", 3, when=every(
        some("TransferHook", "transfer_hook"), regex(r"fn \w*(?:transfer_hook|execute|on_transfer)"), "ctx.accounts",
        some(".amount", ".balance", "transfer", "mint_to"), none(regex(r"authority\s*:\s*Signer"), "signer"))),
    rule("HOOK-LOOP", "Loop inside a transfer hook", 3, when=regex(
        r"(?s)fn \w*(?:transfer_hook|execute|on_transfer)\b.*\n[^\n]*(?:for |while |loop)")),
]


def checklist(findings: DataFrame, properties, by: list[str], category: str = "category") -> DataFrame:
    """Security properties (name, category) and whether each group of findings leaves them intact."""
    every_one = F.array(*[F.struct(F.lit(p).alias("property"), F.lit(c).alias("_cat")) for p, c in properties])
    counts = findings.groupBy(*by, F.col(category).alias("_cat")).agg(F.count(F.lit(1)).alias("n"))
    grid = findings.select(*by).distinct().select(*by, F.inline(every_one))
    return grid.join(counts, [*by, "_cat"], "left").select(*by, "property", F.col("n").isNull().alias("holds"))


#: Security properties and the finding category that breaks each.
PROPERTIES = (
    ("All accounts have owner checks", "MissingOwnerCheck"), ("Arithmetic is overflow safe", "IntegerOverflow"),
    ("Account types cannot be confused", "AccountConfusion"), ("Privileged actions need a signer", "MissingSignerCheck"),
    ("Mutable accounts are distinct", "DuplicateMutableAccounts"), ("Call targets are validated", "ArbitraryCPI"),
    ("Derived addresses use full seeds", "InsecurePDADerivation"), ("Accounts close safely", "CloseAccountDrain"),
    ("Extra accounts are validated", "UncheckedRemainingAccounts"),
)
