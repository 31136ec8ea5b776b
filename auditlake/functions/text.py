"""Column functions over source text: cleaning, names, statement classes, fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(token: str) -> str:
    """Token as a Java regular expression that matches it verbatim."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\\1", token)


def has(col: Column, token: str) -> Column:
    return F.contains(col, F.lit(token))


def has_any(col: Column, tokens) -> Column:
    out = F.lit(False)
    for i, token in enumerate(tokens):
        out = has(col, token) if i == 0 else out | has(col, token)
    return out


def has_all(col: Column, tokens) -> Column:
    out = F.lit(True)
    for i, token in enumerate(tokens):
        out = has(col, token) if i == 0 else out & has(col, token)
    return out


def occurrences(col: Column, token: str) -> Column:
    """Number of non-overlapping occurrences of a literal token."""
    shorter = F.length(F.replace(col, F.lit(token), F.lit("")))
    return ((F.length(col) - shorter) / F.lit(len(token))).cast("int")


def hits(col: Column, tokens) -> Column:
    """How many of the tokens occur at least once."""
    out = F.lit(0)
    for token in tokens:
        out = out + has(col, token).cast("int")
    return out


def line_array(col: Column) -> Column:
    """Lines of a text; a final newline opens no further line."""
    return F.split(F.regexp_replace(col, r"\n\z", ""), "\n", -1)


def line_count(col: Column) -> Column:
    return F.when(F.length(col) == 0, F.lit(0)).otherwise(F.size(line_array(col)))


def strip_spaces(col: Column) -> Column:
    return F.replace(col, F.lit(" "), F.lit(""))


# Type names and attribute openings a token printer spaces out, and the closers it separates.
SPACED_TYPES = (
    "Signer", "Account", "Program", "AccountInfo", "UncheckedAccount", "AccountLoader", "InterfaceAccount", "Interface",
    "SystemAccount", "Context", "Box", "Option", "Vec", "Result", "CpiContext",
)
SPACED_CLOSERS = ("'info", "TokenAccount", "Token", "Mint", "Vault", "System")
SPACED_ATTRIBUTES = (("(signer )", "(signer)"), ("(mut )", "(mut)"), ("(mut , ", "(mut, "), ("(init , ", "(init, "))


def normalize_code(col: Column) -> Column:
    """Undo the blanks a token printer puts into attributes and account types."""
    pairs = [("# [", "#["), *[(f"{t} < ", f"{t}<") for t in SPACED_TYPES], *[(f"{c} >", f"{c}>") for c in SPACED_CLOSERS],
             ("'info , ", "'info, "), *SPACED_ATTRIBUTES]
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def fn_names(col: Column, keyword: str = "fn") -> Column:
    """Names declared with `keyword name`, longer than one character."""
    names = F.regexp_extract_all(col, F.lit(rf"{keyword} ([\p{{L}}\p{{N}}_]+)"), F.lit(1))
    return F.filter(names, lambda n: F.length(n) > 1)


# Words that are never identifiers.
KEYWORDS = (
    "let", "mut", "fn", "pub", "if", "else", "match", "for", "while", "loop", "return", "break", "continue", "in", "as",
    "ref", "move", "self", "Self", "true", "false", "use", "mod", "struct", "enum", "impl", "trait", "where", "type", "const",
    "static", "unsafe", "async", "await", "dyn", "crate", "super",
)


def identifiers(col: Column, keywords=KEYWORDS) -> Column:
    """Distinct identifiers of a text, keywords left out."""
    words = F.regexp_extract_all(col, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\b"), F.lit(1))
    return F.array_except(words, F.array(*[F.lit(k) for k in keywords]))


def basename(col: Column) -> Column:
    return F.element_at(F.split(col, "/"), -1)


def ellipsis(col: Column, n: int) -> Column:
    """First n characters, with dots when something was cut."""
    return F.when(F.length(col) <= n, col).otherwise(F.concat(F.substring(col, 1, n), F.lit("...")))


def fingerprint(cols, length: int | None = None, prefix: str = "") -> Column:
    """SHA-256 over the columns joined by ':'; optionally the first upper-case digits after a prefix."""
    digest = F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)
    if length is not None:
        digest = F.upper(F.substring(digest, 1, length))
    return F.concat(F.lit(prefix), digest) if prefix else digest


# Endings of account structs that carry no part of the instruction name.
STRUCT_SUFFIXES = ("Accounts", "Context", "Ctx")


def instruction_name(col: Column) -> Column:
    """Snake-case instruction name from an account struct name."""
    base = F.regexp_replace(col, f"({'|'.join(STRUCT_SUFFIXES)})$", "")
    return F.lower(F.regexp_replace(base, r"(?<=.)([A-Z])", "_$1"))


def package_from_path(col: Column) -> Column:
    """Package name after the last node_modules/, scope kept; null when there is none."""
    name = F.regexp_extract(col, r".*node_modules/((?:@[^/]+/)?[^/]+)", 1)
    return F.when(name != "", name)


def clean_version(col: Column) -> Column:
    """Strip range operators from the front, each kind in turn."""
    return F.regexp_replace(col, r"^\^*~*(>=)*(<=)*>*<*", "")


def version_listed(version: Column, versions: Column) -> Column:
    """'*' in the list, or the exact version."""
    trimmed = F.transform(versions, lambda v: F.trim(v))
    return F.array_contains(trimmed, F.lit("*")) | F.array_contains(trimmed, version)


def normalized_levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def first_int_over(col: Column, floor: int) -> Column:
    """First whole number in the text that exceeds floor."""
    numbers = F.regexp_extract_all(F.replace(col, F.lit("_"), F.lit("")), F.lit(r"(\d+)"), F.lit(1))
    over = F.filter(F.transform(numbers, lambda n: n.try_cast("bigint")), lambda n: n > floor)
    return F.get(over, F.lit(0))


def json_body(col: Column) -> Column:
    """Text from the first '{' to the last '}'."""
    body = F.regexp_extract(col, r"(?s)(\{.*\})", 1)
    return F.when(body != "", body)


def parse_vote(col: Column):
    """(verdict, confidence) of a reviewer's answer, with the defaults of an unreadable one."""
    parsed = F.from_json(json_body(col), "verdict STRING, confidence DOUBLE")
    return (
        F.upper(F.coalesce(parsed["verdict"], F.lit("UNCERTAIN"))),
        F.coalesce(parsed["confidence"], F.lit(0.5)),
    )


def valid_program_id(col: Column) -> Column:
    return F.length(col).between(20, 60)


def has_flag(col: Column, bit: int) -> Column:
    return col.bitwiseAND(F.lit(bit)) != 0
