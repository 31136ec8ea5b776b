"""Declarative rules and their one-pass evaluation.

A condition is a small tree: a plain string means "the text contains this token" (case-sensitive);
the helpers below combine conditions. Trees are data, so they can be stored as JSON, and they compile
to one boolean Column each.

A pack with many tokens reads each text once: an Arrow UDF marks which tokens occur and combines the marks of a
batch of texts, token by token, into the rules that hold. Patterns and lines stay in the JVM, where such a rule tests
the parts of tokens alone as bits. Small packs use `contains` directly.
"""

from __future__ import annotations

import re
from functools import lru_cache
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def every(*parts):
    return ["every", *parts]


def some(*parts):
    return ["some", *parts]


def none(*parts):
    return ["none", *parts]


def count(token, n):
    """The token occurs at least n times."""
    return ["count", token, n]


def at_least(n, *parts):
    """At least n of the parts hold."""
    return ["at_least", n, *parts]


def regex(pattern, gate=None):
    """The pattern is found. gate: a cheaper condition that holds wherever it is found, tested first."""
    return ["regex", pattern] if gate is None else ["regex", pattern, gate]


def line(part):
    """Some line satisfies the part."""
    return ["line", part]


def lower(part):
    """Evaluate the part on lower-cased text."""
    return ["lower", part]


def within(column, part):
    """Evaluate the part on another text column."""
    return ["within", column, part]


def flag(column):
    """A boolean column."""
    return ["flag", column]


TEST_MARKERS = none("#[test]", "#[cfg(test)]")


def rule(rule_id, name, severity, when, *, emitted=None, base=None, tests=True, category="Heuristic", cwe=None):
    """One rule; tests=False keeps it from firing on test code."""
    if not tests:
        when = every(when, TEST_MARKERS)
    return {
        "id": rule_id, "name": name, "severity": emitted or severity, "registered": severity, "base": base,
        "category": category, "cwe": cwe, "when": when,
    }


#: A pattern's start that may match nothing; what follows decides.
LOOSE_START, WITHOUT_START = r"^(\(\?[a-z]+\))?\\w\*(?![+?*{|)])(?=.)", r"\1"
#: Packs with fewer tokens look for each of them in the JVM, others send the texts to the automaton.
FEW_TOKENS = 64
_SKIP = ("line", "lower", "within", "regex", "flag")


def tokens_of(tree) -> list[str]:
    """Tokens a tree looks up in the main text, in order of appearance."""
    if isinstance(tree, str):
        return [tree]
    kind, *parts = tree
    if kind == "line":
        return _gate_tokens(parts[0])
    if kind in _SKIP:
        return []
    if kind == "count":
        return [parts[0]]
    return [t for p in (parts[1:] if kind == "at_least" else parts) for t in tokens_of(p)]


def _gate_tokens(tree) -> list[str]:
    if isinstance(tree, str):
        return [tree]
    if tree[0] in ("every", "some"):
        return [t for p in tree[1:] for t in _gate_tokens(p)]
    return []


def quote(text: str) -> str:
    """Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _gate(tree, test):
    """What the whole text must contain for one of its lines to satisfy the tree (None: nothing known)."""
    if isinstance(tree, str):
        return test(tree)
    parts = [_gate(p, test) for p in tree[1:]] if tree[0] in ("every", "some") else []
    if tree[0] == "every":
        known = [p for p in parts if p is not None]
        return "(" + " and ".join(known) + ")" if known else None
    if tree[0] == "some" and all(p is not None for p in parts):
        return "(" + " or ".join(parts) + ")"
    return None


def _cost(tree) -> int:
    """How dear a part is to test: 0 tokens, 1 counts and other texts, 2 patterns, 3 lines."""
    if isinstance(tree, str):
        return 0
    kind, *parts = tree
    if kind in ("every", "some", "none", "at_least", "lower", "within"):
        return max([kind in ("lower", "within"), *(_cost(p) for p in parts if not isinstance(p, int))])
    return {"flag": 0, "part": 0, "sql": 0, "count": 1, "regex": 2, "line": 3}[kind]


def condition_sql(tree, text: str, test=None) -> str:
    """SQL of a condition tree over a text expression; test(token) looks a token up in that text.

    One SQL string per rule keeps the driver fast: a pack has thousands of nodes.
    """
    test = test or (lambda token: f"contains({text}, {quote(token)})")
    if isinstance(tree, str):
        return test(tree)
    kind, *parts = tree
    if kind in ("every", "some"):
        # parts have no nulls, so their order is free: dear ones are only tested where cheap ones leave it open
        return "(" + (" and " if kind == "every" else " or ").join(condition_sql(p, text, test) for p in sorted(parts, key=_cost)) + ")"
    if kind == "none":
        return "(not " + condition_sql(["some", *parts], text, test) + ")"
    if kind == "count":
        return f"({count_sql(parts[0], text, test)} >= {parts[1]})"
    if kind == "at_least":
        return "((" + " + ".join(f"cast({condition_sql(p, text, test)} as int)" for p in parts[1:]) + f") >= {parts[0]})"
    if kind == "regex":
        # a text has a match of \w*X where it has one of X; without the start, words are not read again from each of their letters
        found = f"({text} rlike {quote(re.sub(LOOSE_START, WITHOUT_START, parts[0]))})"
        return f"({condition_sql(parts[1], text)} and {found})" if parts[1:] else found
    if kind == "line":
        found = f"exists(split({text}, '\\\\n'), one_line -> {condition_sql(parts[0], 'one_line')})"
        gate = _gate(parts[0], test)
        return found if gate is None else f"({gate} and {found})"
    if kind == "lower":
        return condition_sql(parts[0], f"lower({text})")
    if kind == "within":
        return condition_sql(parts[1], parts[0])
    if kind == "flag":
        return f"coalesce({parts[0]}, false)"
    if kind == "part":
        return part_sql(parts[0])
    if kind == "sql":
        return parts[0]
    raise ValueError(f"unknown condition {kind}")


def part_sql(i: int) -> str:
    """SQL of a part that the UDF of rules has tested."""
    return f"(getbit(get(_found.parts, {i // 64}), {i % 64}) = 1)"


def count_sql(token: str, text: str, test=None) -> str:
    """SQL of the number of occurrences; texts without the token are not searched again."""
    n = f"(length({text}) - length(replace({text}, {quote(token)}, ''))) div {len(token)}"
    return f"(case when {test(token)} then {n} else 0 end)" if test else f"({n})"


def condition(tree, text: str, test=None) -> Column:
    """Boolean Column of a condition tree over a text column or SQL expression."""
    return F.expr(condition_sql(tree, text, test))


@lru_cache(maxsize=16)
def _machine(tokens: tuple[str, ...]):
    """Automaton over the tokens, built once in a worker."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, token in enumerate(tokens):
        machine.add_word(token, i)
    machine.make_automaton()
    return machine


def _marker(tokens: tuple[str, ...]):
    """Arrow UDF text -> array of 64-bit words; bit i says whether tokens[i] occurs. A null text is empty."""
    import pandas as pd

    words = (len(tokens) + 63) // 64

    def mark(texts: pd.Series) -> pd.Series:
        import numpy as np

        machine, second = _machine(tokens), itemgetter(1)

        def bits(text):
            found = 0
            for i in set(map(second, machine.iter(text or ""))):
                found |= 1 << i
            return np.frombuffer(found.to_bytes(words * 8, "little"), dtype="<i8")

        return texts.map(bits)

    mark.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(mark, "array<bigint>")


def with_token_test(df: DataFrame, trees, text: str):
    """(df, test): df prepared so that test(token) is cheap SQL, for all tokens of the trees. A null text counts as empty."""
    df = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    tokens = tuple(dict.fromkeys(t for tree in trees for t in tokens_of(tree) if t))
    if len(tokens) < FEW_TOKENS:
        return df, None
    place = {t: i for i, t in enumerate(tokens)}
    marked = df.withColumn("_bits", _marker(tokens)(F.col(text)))

    def test(token):
        if token == "":
            return "true"
        i = place[token]
        return f"(getbit(get(_bits, {i // 64}), {i % 64}) = 1)"

    return marked, test


def _of_tokens(tree) -> bool:
    """Whether tokens of the main text decide the tree."""
    return isinstance(tree, str) or tree[0] == "count" or tree[0] not in _SKIP and all(_of_tokens(p) for p in tree[1:] if not isinstance(p, int))


def _with_parts(tree, part):
    """The tree with part(subtree) in place of its subtrees of tokens alone."""
    if _of_tokens(tree):
        return part(tree)
    kind, *rest = tree
    if kind in ("every", "some", "none"):
        plain, dear = [p for p in rest if _of_tokens(p)], [p for p in rest if not _of_tokens(p)]
        held = [part(["every" if kind == "every" else "some", *plain])] if plain else []
        return [kind, *held, *(_with_parts(p, part) for p in dear)]
    if kind == "at_least":
        return [kind, rest[0], *(_with_parts(p, part) for p in rest[1:])]
    return tree


#: Characters of texts that are searched together.
SEARCHED = 1 << 20


def _holding(trees: tuple, n_rules: int, tokens: tuple[str, ...]):
    """Arrow UDF text -> struct(hits: which of the first n_rules trees hold, parts: bits of the others). A null text is empty."""
    import pyarrow as pa

    words = max(1, (len(trees) - n_rules + 63) // 64)

    def chunk(texts):
        import numpy as np

        place, n = {t: i for i, t in enumerate(tokens)}, len(texts)
        # no token holds a null character, so none is found across two texts
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=n) + 1)
        found = list(_machine(tokens).iter("\0".join(texts)))
        rows = np.searchsorted(ends, np.fromiter(map(itemgetter(0), found), dtype=np.int64, count=len(found)), side="right")
        marks = np.zeros((len(tokens), n), dtype=bool)
        marks[np.fromiter(map(itemgetter(1), found), dtype=np.int64, count=len(found)), rows] = True

        def holds(tree):
            if isinstance(tree, str):
                return marks[place[tree]] if tree else np.ones(n, dtype=bool)
            kind, *parts = tree
            if kind == "count":
                token, least = parts
                out = np.full(n, least <= 0)
                if least > 0:
                    asked = np.flatnonzero(marks[place[token]])
                    out[asked] = [texts[i].count(token) >= least for i in asked]
                return out
            if kind == "every":
                return np.logical_and.reduce([holds(p) for p in parts])
            if kind == "at_least":
                return np.sum([holds(p) for p in parts[1:]], axis=0) >= parts[0]
            some_hold = np.logical_or.reduce([holds(p) for p in parts])
            return ~some_hold if kind == "none" else some_hold

        table = np.array([holds(tree) for tree in trees]).T
        at, which = np.nonzero(table[:, :n_rules])
        bits = np.zeros((n, words * 64), dtype=bool)
        bits[:, : len(trees) - n_rules] = table[:, n_rules:]
        return np.bincount(at, minlength=n), which.astype(np.int32), np.packbits(bits, axis=1, bitorder="little").view("<i8")

    def mark(texts):
        import numpy as np

        strings, parts, start, size = [t or "" for t in texts.to_pylist()], [], 0, 0
        for i, text in enumerate(strings):
            size += len(text)
            if size >= SEARCHED:
                parts.append(chunk(strings[start : i + 1]))
                start, size = i + 1, 0
        if start < len(strings):
            parts.append(chunk(strings[start:]))
        counts, hits, bits = ([np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, dtype=np.int32)] * 3)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hits, pa.int32()))
        ends = pa.array(np.arange(len(strings) + 1, dtype=np.int32) * words)
        return pa.StructArray.from_arrays([held, pa.ListArray.from_arrays(ends, pa.array(bits.ravel(), pa.int64()))], ["hits", "parts"])

    mark.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(mark, "struct<hits:array<int>,parts:array<bigint>>")


def _rules_that_hold(units: DataFrame, rules: list[dict], text: str, keep: list[str]) -> DataFrame | None:
    """keep and `_at`, the places of the rules that hold, in order after nulls; None for packs with few tokens. A null text counts as empty."""
    trees = [r["when"] for r in rules]
    tokens = tuple(dict.fromkeys(t for tree in trees for t in tokens_of(tree) if t))
    if len(tokens) < FEW_TOKENS or any("\0" in t for t in tokens):
        return None
    plain, parts = [i for i, tree in enumerate(trees) if _of_tokens(tree)], []

    def part(tree):
        if tree not in parts:
            parts.append(tree)
        return ["part", parts.index(tree)]

    dear = {i: _with_parts(tree, part) for i, tree in enumerate(trees) if i not in set(plain)}
    units = units.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    tests = {i: condition_sql(tree, text, lambda token: part_sql(part(token)[1])) for i, tree in dear.items()}
    units = units.withColumn("_found", _holding((*[trees[i] for i in plain], *parts), len(plain), tokens)(F.col(text)))
    places = F.transform("_found.hits", lambda k: F.get(F.lit(plain), k)) if dear else F.col("_found.hits")
    if not dear:
        return units.select(*keep, places.alias("_at"))
    # nulls stay: a function that drops them here would have all the tests interpreted
    more = F.expr(f"array({', '.join(f'case when {sql} then {i} end' for i, sql in tests.items())})")
    return units.select(*keep, F.sort_array(F.concat(places, more)).alias("_at"))


def scan_rules(units: DataFrame, rules: list[dict], text: str = "code", keep: list[str] | None = None) -> DataFrame:
    """Findings of every rule on every unit: one projection, no join, no shuffle.

    Adds id, rule_pos (place in the list), vuln_type, severity, category, cwe.
    """
    keep = keep or [c for c in units.columns if c != text]
    held = _rules_that_hold(units, rules, text, keep)
    if held is not None:
        about = ", ".join(
            f"named_struct('id', {quote(r['id'])}, 'rule_pos', {i}, 'vuln_type', {quote(r['name'])}, 'severity', {r['severity']}, 'category', "
            f"{quote(r['category'])}, 'cwe', cast({quote(r['cwe']) if r['cwe'] else 'null'} as string))" for i, r in enumerate(rules))
        rows = held.select(*keep, F.explode_outer("_at").alias("_i")).filter("_i is not null")
        return rows.select(*keep, F.expr(f"get(array({about}), _i)").alias("_r")).select(*keep, "_r.*")
    units, test = with_token_test(units, [r["when"] for r in rules], text)
    hit = [
        f"case when {condition_sql(r['when'], text, test)} then named_struct('id', {quote(r['id'])}, 'rule_pos', {i}, "
        f"'vuln_type', {quote(r['name'])}, 'severity', {r['severity']}, 'category', {quote(r['category'])}, "
        f"'cwe', cast({quote(r['cwe']) if r['cwe'] else 'null'} as string)) end"
        for i, r in enumerate(rules)
    ]
    # inline + filter stays inside generated code; array_compact would evaluate every rule interpreted
    return units.select(*keep, F.expr(f"inline(array({', '.join(hit)}))")).filter("id is not null")


def emit(df: DataFrame, keep, tests: list[Column], mark: str) -> DataFrame:
    """One row per test that holds; tests are when(condition, struct) columns, mark is a struct field
    that is never null. Inline and filter stay in generated code."""
    return df.select(*keep, F.inline(F.array(*tests))).filter(F.col(mark).isNotNull())


def rule_hits(units: DataFrame, rules: list[dict], text: str = "code", keep: list[str] | None = None) -> DataFrame:
    """Like scan_rules, but one row per unit with the array of rule ids that fired."""
    keep = keep or [c for c in units.columns if c != text]
    held = _rules_that_hold(units, rules, text, keep)
    if held is not None:
        return held.select(*keep, F.transform(F.array_compact("_at"), lambda i: F.get(F.lit([r["id"] for r in rules]), i)).alias("ids"))
    units, test = with_token_test(units, [r["when"] for r in rules], text)
    hit = [f"case when {condition_sql(r['when'], text, test)} then {quote(r['id'])} end" for r in rules]
    return units.select(*keep, F.expr(f"array_compact(array({', '.join(hit)}))").alias("ids"))


def rule_table(spark, rules: list[dict]) -> DataFrame:
    """The rules as rows: pos, id, name, severity, base_confidence, category."""
    rows = [(i, r["id"], r["name"], r["registered"], r["base"], r["category"]) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "pos int, id string, name string, severity int, base_confidence int, category string"
    )


def _vector_udf(fn):
    import pandas as pd

    def call(s: pd.Series) -> pd.Series:
        return fn(s)

    call.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, "boolean")


def scan_callbacks(units: DataFrame, callbacks: dict, text: str = "code", keep: list[str] | None = None) -> DataFrame:
    """Escape hatch: {rule id: pandas function Series[str] -> Series[bool]} in one Arrow pass per rule."""
    keep = keep or [c for c in units.columns if c != text]
    tests = [F.when(_vector_udf(fn)(F.col(text)), F.lit(name)) for name, fn in callbacks.items()]
    hits = units.select(*keep, F.array(*tests).alias("_ids"))
    return hits.select(*keep, F.explode(F.array_compact("_ids")).alias("id"))
