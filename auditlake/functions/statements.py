"""Statement classes, assignments and calls as column functions over one line of code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import has, has_any, strip_spaces

# The tokens of each statement class, tested in this order.
AUTH = ("is_signer", "#[account(signer", "has_one")


def classify_stmt(code: Column) -> Column:
    """Class of a statement; the first class that matches wins."""
    low, tight = F.lower(code), strip_spaces(code)
    required = has(code, "require!") & has_any(code, ("authority", "signer", "admin"))
    owner = has(code, "constraint") & has(code, "owner")
    asserted = has(low, "assert_") & ~has_any(low, ("assert_eq!", "assert_ne!")) & has_any(code, ("(", "?"))
    loader = has(low, "get_") & has(low, "_data") & has(code, "program_id")
    derived = has_any(code, ("find_program_address", "create_program_address"))
    call = has_any(tight, ("invoke(", "invoke_signed(")) | has(code, "CpiContext") | (has(code, "anchor_lang") & has(code, "invoke"))
    transfer = has_any(code, ("transfer", "Transfer")) & has_any(code, ("token", "lamport", "sol"))
    compound = has_any(code, ("-=", "+=", "*=", "/=")) & has(code, ".")
    field = has(code, "=") & ~has(code, "==") & ~has(code, "let") & has_any(code, (".amount", ".balance", ".data", ".state"))
    return (
        F.when(has_any(code, AUTH) | required | owner | asserted | loader | derived, "auth")
        .when(call, "cpi").when(transfer, "transfer")
        .when(has(code, "borrow_mut") | compound | field, "mutation")
        .when(has(code, "init") & has_any(code, ("payer", "space")), "init")
        .when(has_any(code, ("return Err", "err!", "error!")), "error")
        .when(code.startswith("match ") | has(code, "if "), "branch")
        .when(has_any(code, ("for ", "while ", "loop ")), "loop")
        .when(has_any(code, ("+", "-", "*", "/")), "arithmetic")
        .otherwise("normal")
    )


def stmt_kind(code: Column) -> Column:
    """Instruction statement kind: Require, CPI, CheckedArithmetic, Arithmetic, Assignment."""
    checked = r"checked_(?:add|sub|mul|div)"
    return (
        F.when(code.rlike(r"\b(?:require|assert|assert_eq|assert_ne)!?\s*\("), "Require")
        .when(code.rlike(r"^\s*let\b"), "Assignment")
        .when(code.rlike(rf"\.{checked}\s*\("), "CheckedArithmetic")
        .when(code.rlike(r"\binvoke(?:_signed(?:_unchecked)?)?\s*\("), "CPI")
        .when(code.rlike(r"[\w)\]] ?[-+*/]=? "), "Arithmetic")
    )


# Words the assignment reader does not take for variables.
NOT_VARIABLES = (
    "let", "mut", "pub", "fn", "if", "else", "match", "return", "true", "false", "self", "Self", "as", "u8", "u16", "u32",
    "u64", "u128", "i8", "i16", "i32", "i64", "i128", "usize", "isize", "bool", "str", "String", "Ok", "Err", "Some", "None",
    "Result", "Option", "Vec",
)


def variables(col: Column) -> Column:
    words = F.regexp_extract_all(col, F.lit(r"\b([A-Za-z_]\w*+)\b"), F.lit(1))
    return F.array_except(words, F.array(*[F.lit(w) for w in NOT_VARIABLES]))


#: `let [mut] name ... = rhs` or `target = rhs`; the comparison operators do not assign.
_LET = r"^\s*let\s+(?:mut\s+)?(\w+)[^=]*=\s*([\s\S]*)$"
_SET = r"^\s*([^=!<>]*?)(\w+)\W*[^=!<>\w]?=(?!=)\s*([\s\S]*)$"


def assignment(code: Column) -> tuple[Column, Column]:
    """(assigned variable or null, right-hand side text)."""
    is_let = code.rlike(r"^\s*let\b")
    # neither pattern matches without a sign, and looking for one costs far less
    signed = lambda found: F.when(has(code, "="), found).when(code.isNotNull(), F.lit(""))
    name = signed(F.when(is_let, F.regexp_extract(code, _LET, 1)).otherwise(F.regexp_extract(code, _SET, 2)))
    rhs = signed(F.when(is_let, F.regexp_extract(code, _LET, 2)).otherwise(F.regexp_extract(code, _SET, 3)))
    return F.nullif(name, F.lit("")), rhs


# Taint levels: 0 untainted, 1 signer-controlled, 2 account input, 3 arithmetic-derived, 4 external, 5 tainted.
UNTAINTED, SIGNER, ACCOUNT, ARITHMETIC, EXTERNAL, TAINTED = range(6)
# Tokens that set the level of an assigned value, in order.
VALIDATED = ("checked_", "require!", "assert!", "validate", "is_signer")
OUTSIDE = ("get_price", "oracle", "pyth", "switchboard", "invoke", "CpiContext")
FROM_ACCOUNT = ("ctx.accounts", "AccountInfo", ".data", ".lamports", "try_borrow_data", "deserialize")


def fixed_level(code: Column) -> Column:
    """Level an assignment has whatever its operands are; null when the operands decide."""
    return (
        F.when(code.rlike(r"^\s*\d+\s*;?\s*$") | has(code, '"'), UNTAINTED)
        .when(has_any(code, VALIDATED), SIGNER).when(has_any(code, OUTSIDE), EXTERNAL)
        .when(has_any(code, FROM_ACCOUNT), ACCOUNT)
    )


def is_arithmetic(code: Column) -> Column:
    return has_any(code, ("+", "-", "*", "/"))


def param_level(type_text: Column) -> Column:
    """Level of a parameter by its type; null for types that carry no outside data."""
    return (
        F.when(has(type_text, "Context<"), ACCOUNT).when(has(type_text, "AccountInfo"), TAINTED)
        .when(has_any(type_text, ("u64", "u128", "i64")), ACCOUNT).when(has_any(type_text, ("Pubkey", "&[u8]")), ACCOUNT)
    )
