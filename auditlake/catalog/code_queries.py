"""Text relations, rule packs, project context and source scan over the derived code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.base import query, table
from auditlake.catalog.corpus import FILES_SQL, UNITS_SQL, code_files, distinct_files, distinct_texts, files_by_path, sql_condition
from auditlake.functions import text as tx
from auditlake.operators import scores
from auditlake.rules import context as ctx
from auditlake.rules import packs
from auditlake.rules.engine import scan_rules
from auditlake.session import spread
from auditlake.sources.corpus import enclosing_unit, explode_lines, extract_structs, extract_units, join_context, units_with_context, validate_path, validate_source, with_snippet

KEEP = ["program", "file_path", "file_name"]


def units(spark, sf):
    return units_with_context(code_files(spark, sf), keep=KEEP)


# --- plain text -----------------------------------------------------------------------------------

LINES_SQL = "lines AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS line_no FROM documents)"


@query("explode_lines", f"WITH {LINES_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, length(line) AS n, trim(line) = '' AS is_blank, starts_with(trim(line), '//') AS is_comment FROM lines")
def explode_lines_query(spark, sf):
    out = explode_lines(table(spark, sf, "documents"), "text", ["doc_id"])
    return out.select("doc_id", "line_no", F.length("line").cast("bigint").alias("n"), "is_blank", "is_comment")


@query("with_snippet", f"WITH {LINES_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, md5(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS snippet FROM lines")
def with_snippet_query(spark, sf):
    out = with_snippet(table(spark, sf, "documents"), 2, "text", ["doc_id"])
    return out.select("doc_id", "line_no", F.md5("snippet").alias("snippet"))


@query("enclosing_unit", f"""WITH {LINES_SQL}, m AS (SELECT *, last_value(nullif(regexp_extract(line, '^(The|Of|And|De|La) ', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS u FROM lines)
 SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, coalesce(u, 'unknown') AS unit FROM m""")
def enclosing_unit_query(spark, sf):
    out = enclosing_unit(table(spark, sf, "documents"), "text", ["doc_id"], "(?:The|Of|And|De|La) ", r"^(The|Of|And|De|La) ")
    return out.select("doc_id", "line_no", F.col("fn_name").alias("unit"))


@query("extract_units", f"WITH {UNITS_SQL} SELECT file_path, fn_name, md5(bare) AS code FROM units")
def extract_units_query(spark, sf):
    out = extract_units(code_files(spark, sf), keep=KEEP)
    return out.select("file_path", "fn_name", F.md5("code").alias("code"))


CONTEXT_SQL = f"WITH {UNITS_SQL} SELECT file_path, fn_name, md5(code) AS code FROM units"


@query("units_with_context", CONTEXT_SQL)
def units_with_context_query(spark, sf):
    return units(spark, sf).select("file_path", "fn_name", F.md5("code").alias("code"))


@query("join_context", CONTEXT_SQL)
def join_context_query(spark, sf):
    files = files_by_path(spark, sf)
    out = join_context(extract_units(files, keep=KEEP), extract_structs(files, keep=KEEP))
    return out.select("file_path", "fn_name", F.md5("code").alias("code"))


@query("identifiers", """SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(regexp_replace(text, '[\\p{L}\\p{N}_]*[^\\x00-\\x7F][\\p{L}\\p{N}_]*', ' ', 'g'), '\\b([A-Za-z_][A-Za-z0-9_]*)\\b', 1), lambda w: w NOT IN ('in', 'as', 'for', 'use', 'impl', 'if', 'else', 'let', 'mut', 'fn', 'pub', 'match', 'while', 'loop', 'return', 'break', 'continue', 'ref', 'move', 'self', 'Self', 'true', 'false', 'mod', 'struct', 'enum', 'trait', 'where', 'type', 'const', 'static', 'unsafe', 'async', 'await', 'dyn', 'crate', 'super')))) AS n FROM documents""")
def identifiers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.identifiers(F.col("text"))).cast("bigint").alias("n"))


@query("fn_names", f"WITH {FILES_SQL} SELECT file_path, list_distinct(regexp_extract_all(content, 'fn ([\\w]+)', 1)) AS names FROM texts".replace("SELECT file_path, list_distinct(regexp_extract_all(content, 'fn ([\\w]+)', 1)) AS names", "SELECT file_path, array_to_string(regexp_extract_all(content, 'fn (\\w+)', 1), ',') AS names"))
def fn_names(spark, sf):
    return code_files(spark, sf).select("file_path", F.array_join(tx.fn_names(F.col("content")), ",").alias("names"))


@query("strip_spaces", "SELECT doc_id, md5(replace(text, ' ', '')) AS stripped FROM documents")
def strip_spaces(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.strip_spaces(F.col("text"))).alias("stripped"))


_NORMAL = "replace(replace(text, ' the ', ' Signer < '), ' of ', ' Token > ')"


@query("normalize_code", f"SELECT doc_id, md5(replace(replace({_NORMAL}, 'Signer < ', 'Signer<'), 'Token >', 'Token>')) AS code FROM documents")
def normalize_code(spark, sf):
    """Prose with two words read as spaced type names."""
    spaced = F.replace(F.replace("text", F.lit(" the "), F.lit(" Signer < ")), F.lit(" of "), F.lit(" Token > "))
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.normalize_code(spaced)).alias("code"))


@query("fingerprint", "SELECT doc_id, 'DOC-' || substring(upper(sha256(source || ':' || lang || ':' || text)), 1, 16) AS fp FROM documents")
def fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.fingerprint(["source", "lang", "text"], 16, "DOC-").alias("fp"))


def _both_sides(accepted, rejected, key):
    return accepted.select(key, F.lit(None).cast("string").alias("reason")).unionByName(rejected.select(key, "reason"))


@query("validate_source", "SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN strlen(text) > 2000 THEN 'too long' WHEN contains(text, chr(0)) THEN 'binary' END AS reason FROM documents")
def validate_source_query(spark, sf):
    return _both_sides(*validate_source(table(spark, sf, "documents"), "text", 2000), "doc_id")


@query("validate_path", """SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'traversal' WHEN o_orderkey % 60 + 1 + (o_custkey % 2) > 50 THEN 'too deep' END AS reason FROM orders""")
def validate_path_query(spark, sf):
    root = F.when(F.col("o_custkey") % 2 == 1, "/").otherwise("")
    up = F.when(F.col("o_custkey") % 7 == 0, "../").otherwise("")
    path = F.concat(root, F.repeat(F.lit("d/"), (F.col("o_orderkey") % 60).cast("int")), up, F.lit(".//x.rs"))
    return _both_sides(*validate_path(table(spark, sf, "orders").select("o_orderkey", path.alias("file_path"))), "o_orderkey")


@query("valid_program_id", "SELECT page_id, length(url) BETWEEN 20 AND 60 AS valid FROM pages")
def valid_program_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.valid_program_id(F.col("url")).alias("valid"))


@query("has_flag", "SELECT p_partkey, (p_size & 4) <> 0 AS flagged FROM part")
def has_flag(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.has_flag(F.col("p_size"), 4).alias("flagged"))


@query("package_from_path", """SELECT page_id, nullif(regexp_extract(replace(url, '://', '/node_modules/'), 'node_modules/((?:@[^/]+/)?[^/]+)', 1), '') AS package FROM pages""")
def package_from_path(spark, sf):
    path = F.replace("url", F.lit("://"), F.lit("/node_modules/"))
    return table(spark, sf, "pages").select("page_id", tx.package_from_path(path).alias("package"))


@query("instruction_name", "SELECT p_partkey, lower(regexp_replace(regexp_replace(p_type || p_brand, '(Accounts|Context|Ctx)$', ''), '(.)([A-Z])', '\\1_\\2', 'g')) AS name FROM (SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) AS p_type, CASE WHEN p_size % 3 = 0 THEN 'Accounts' WHEN p_size % 3 = 1 THEN 'PoolContext' ELSE 'NewCtx' END AS p_brand FROM part)")
def instruction_name(spark, sf):
    tail = F.when(F.col("p_size") % 3 == 0, "Accounts").when(F.col("p_size") % 3 == 1, "PoolContext").otherwise("NewCtx")
    return table(spark, sf, "part").select("p_partkey", tx.instruction_name(F.concat(F.initcap(F.lower("p_type")), tail)).alias("name"))


@query("clean_version", "SELECT p_partkey, CAST(p_size AS VARCHAR) || '.0' AS version, p_size IN (3, 5, 8) OR p_brand = 'Brand#7' AS listed FROM part")
def clean_version(spark, sf):
    mark = F.when(F.col("p_size") % 4 == 0, "^").when(F.col("p_size") % 4 == 1, "~").when(F.col("p_size") % 4 == 2, ">=").otherwise("<")
    raw = F.concat(mark, F.col("p_size").cast("string"), F.lit(".0"))
    listed = F.when(F.col("p_brand") == "Brand#7", F.array(F.lit("*"))).otherwise(F.array(F.lit("3.0"), F.lit(" 5.0"), F.lit("8.0 ")))
    version = tx.clean_version(raw)
    return table(spark, sf, "part").select("p_partkey", version.alias("version"), tx.version_listed(version, listed).alias("listed"))


@query("first_int_over", "SELECT doc_id, list_filter(list_transform(regexp_extract_all(replace(text, '_', ''), '[0-9]+'), lambda n: try_cast(n AS BIGINT)), lambda n: n > 1000)[1] AS n FROM documents")
def first_int_over(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.first_int_over(F.col("text"), 1000).alias("n"))


@query("parse_vote", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'UNCERTAIN' ELSE upper(event_type) END AS verdict, CASE WHEN event_type IN ('view', 'click') THEN 0.5 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) / 100 END AS confidence FROM events""")
def parse_vote(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") / 100
    t = F.col("event_type")
    body = F.when(t == "view", "no opinion").when(t == "click", F.concat(F.lit('so: {"verdict": "'), t, F.lit('"} ok'))).otherwise(
        F.concat(F.lit('answer:\n{"verdict": "'), t, F.lit('", "confidence": '), k.cast("string"), F.lit("}\nend")))
    verdict, confidence = tx.parse_vote(body)
    return table(spark, sf, "events").select("event_id", verdict.alias("verdict"), confidence.alias("confidence"))


# --- rule packs -----------------------------------------------------------------------------------

def pack_sql(rules, source="units", text="code", keys="file_path, fn_name"):
    parts = ", ".join(f"CASE WHEN {sql_condition(r['when'], text)} THEN '{r['id']}#{i}' END" for i, r in enumerate(rules))
    return f"SELECT {keys}, unnest(list_filter([{parts}], lambda hit: hit IS NOT NULL)) AS hit FROM {source}"


def pack_counts_sql(with_sql, rules, **kw):
    return f"""WITH {with_sql}, h AS ({pack_sql(rules, keys='program', **kw)})
 SELECT program, split_part(hit, '#', 1) AS id, CAST(split_part(hit, '#', 2) AS INTEGER) AS rule_pos, count(*) AS n FROM h GROUP BY ALL"""


def pack_counts(df, rules, text="code"):
    return scan_rules(df, rules, text, ["program"]).groupBy("program", "id", "rule_pos").agg(F.count(F.lit(1)).alias("n"))


from auditlake.rules.core_pack import CORE  # noqa: E402
from auditlake.rules.structure_pack import STRUCTURE  # noqa: E402


@query("rules_core", pack_counts_sql(UNITS_SQL, CORE))
def rules_core(spark, sf):
    return pack_counts(units(spark, sf), CORE)


@query("rules_structure", pack_counts_sql(UNITS_SQL, STRUCTURE))
def rules_structure(spark, sf):
    return pack_counts(units(spark, sf), STRUCTURE)


@query("rules_defi", pack_counts_sql(UNITS_SQL, packs.DEFI))
def rules_defi(spark, sf):
    return pack_counts(units(spark, sf), packs.DEFI)


@query("rules_binary", pack_counts_sql(UNITS_SQL, packs.BINARY_RISKS))
def rules_binary(spark, sf):
    return pack_counts(units(spark, sf), packs.BINARY_RISKS)


@query("rules_calls", pack_counts_sql(UNITS_SQL, packs.CALL_RISKS))
def rules_calls(spark, sf):
    return pack_counts(units(spark, sf), packs.CALL_RISKS)


@query("rules_safety", pack_counts_sql(FILES_SQL, packs.SAFETY_CHECKS, source="texts", text="content"))
def rules_safety(spark, sf):
    return pack_counts(code_files(spark, sf), packs.SAFETY_CHECKS, "content")


@query("rules_hooks", pack_counts_sql(FILES_SQL, packs.HOOK_RULES, source="(SELECT program, replace(content, 'process_move', 'transfer_hook') AS content FROM texts)", text="content"))
def rules_hooks(spark, sf):
    df = code_files(spark, sf).withColumn("content", F.replace("content", F.lit("process_move"), F.lit("transfer_hook")))
    return pack_counts(df, packs.HOOK_RULES, "content")


@query("rules_compatibility", pack_counts_sql(FILES_SQL, packs.COMPATIBILITY, text="content", source="(SELECT program, replace(replace(replace(content, 'unix_timestamp', 'unix_timestamp + 1'), 'lamports.borrow_mut', 'try_borrow_mut_data'), 'unsafe', 'SlotHashes') AS content FROM texts)"))
def rules_compatibility(spark, sf):
    df = code_files(spark, sf)
    for old, new in (("unix_timestamp", "unix_timestamp + 1"), ("lamports.borrow_mut", "try_borrow_mut_data"), ("unsafe", "SlotHashes")):
        df = df.withColumn("content", F.replace("content", F.lit(old), F.lit(new)))
    return pack_counts(df, packs.COMPATIBILITY, "content")


DOC_RULES = [
    {"id": "DOC-LICENSE", "name": "", "severity": 1, "category": "", "cwe": None, "when": ["some", "License", "licensed"]},
    {"id": "DOC-SECRET", "name": "", "severity": 5, "category": "", "cwe": None, "when": ["every", "token", ["regex", "[0-9a-f]{32}"]]},
    {"id": "DOC-NOISE", "name": "", "severity": 2, "category": "", "cwe": None, "when": ["some", ["count", "###", 2], ["at_least", 2, "$$$", "%%%", "&&&"]]},
    {"id": "DOC-PROSE", "name": "", "severity": 1, "category": "", "cwe": None, "when": ["every", ["line", ["every", " the ", " of "]], ["none", " que ", " der "]]},
]


@query("rules_documents", f"WITH h AS ({pack_sql(DOC_RULES, 'documents', 'text', 'doc_id')}) SELECT doc_id, split_part(hit, '#', 1) AS id FROM h")
def rules_documents(spark, sf):
    return scan_rules(table(spark, sf, "documents"), DOC_RULES, "text", ["doc_id"]).select("doc_id", "id")


#: Common words of the prose, read as code words so that the pack has something to find.
SWAPS = ((" the ", " transfer "), (" of ", " authority "), (" and ", " amount / rate "), (" que ", " oracle "), (" der ", " swap( "), (" is ", " pool "), (" la ", " vote "),
         (" that ", " invoke( "), (" en ", " freeze metadata "), (" und ", " borrow liquidate "), (" el ", " Vec< pub fn "))
SWAPPED_SQL = "text"
for _old, _new in SWAPS:
    SWAPPED_SQL = f"replace({SWAPPED_SQL}, '{_old}', '{_new}')"


@query("rules_core_documents", f"WITH t AS (SELECT doc_id, {SWAPPED_SQL} AS body FROM documents), h AS ({pack_sql(CORE, 't', 'body', 'doc_id')}) SELECT doc_id, split_part(hit, '#', 1) AS id FROM h")
def rules_core_documents(spark, sf):
    text = F.col("text")
    for old, new in SWAPS:
        text = F.replace(text, F.lit(old), F.lit(new))
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text.alias("body"))
    return scan_rules(docs, CORE, "body", ["doc_id"]).select("doc_id", "id")


@query("scan_callbacks", "SELECT doc_id, 'CB-DIGITS' AS id FROM documents WHERE len(regexp_extract_all(text, '[0-9]')) >= 10")
def scan_callbacks_query(spark, sf):
    import pandas as pd

    from auditlake.rules.engine import scan_callbacks

    def many_digits(s: pd.Series) -> pd.Series:
        return s.str.count("[0-9]") >= 10

    return scan_callbacks(table(spark, sf, "documents"), {"CB-DIGITS": many_digits}, "text", ["doc_id"])


@query("feature_flags", f"WITH {FILES_SQL} SELECT file_path, " + ", ".join(f"{sql_condition(t, 'content')} AS {n}" for n, t in packs.FEATURES.items()) + " FROM texts")
def feature_flags(spark, sf):
    return packs.feature_flags(code_files(spark, sf), keep=["file_path"])


def _line_sql(patterns, source, text, keys):
    tests = ", ".join(
        f"CASE WHEN regexp_matches(line, '{p[4].replace(chr(39), chr(39) * 2)}') THEN '{p[0]}|' || CASE WHEN doc THEN '{p[3]}' ELSE '{p[2]}' END END" for p in patterns)
    return f"""l AS (SELECT {keys}, unnest(string_split(regexp_replace({text}, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace({text}, '\\n$', ''), chr(10)), 1) AS line_no FROM {source}),
 d AS (SELECT *, coalesce(regexp_matches(trim(lag(line, 1) OVER w), '^///? SAFETY:') OR regexp_matches(trim(coalesce(lag(line, 2) OVER w, '')), '^///? SAFETY:') OR regexp_matches(trim(coalesce(lag(line, 3) OVER w, '')), '^///? SAFETY:'), FALSE) AS doc FROM l WINDOW w AS (PARTITION BY {keys} ORDER BY line_no)),
 hit AS (SELECT {keys}, line_no, unnest(list_filter([{tests}], lambda x: x IS NOT NULL)) AS h FROM d WHERE NOT (starts_with(trim(line), '//') OR starts_with(trim(line), '/*') OR starts_with(trim(line), '*')))"""


UNSAFE_TEXT = "replace(replace(content, 'Ok(())', '// SAFETY: checked' || chr(10) || 'unsafe { let q = p as *const u8; }'), 'Ok(amount)', 'unsafe { invoke(transmute::<A, B>(x)) }')"


@query("scan_unsafe", f"""WITH {FILES_SQL}, t AS (SELECT DISTINCT file_path, {UNSAFE_TEXT} AS body FROM texts), {_line_sql(packs.UNSAFE_LINES, 't', 'body', 'file_path')},
 p AS (SELECT hit.file_path, hit.line_no, split_part(h, '|', 1) AS id, split_part(h, '|', 2) AS s, line FROM hit JOIN l USING (file_path, line_no))
 SELECT file_path, CAST(line_no AS INTEGER) AS line_no, id, CASE WHEN id = 'unsafe_block' AND regexp_matches(line, 'invoke|sol_memcpy|sol_memset|AccountInfo|from_raw_parts') THEN CASE WHEN s = 'High' THEN 'Critical' ELSE 'High' END ELSE s END AS severity FROM p""")
def scan_unsafe(spark, sf):
    safe = "// SAFETY: checked\nunsafe { let q = p as *const u8; }"
    df = distinct_texts(spark, sf).select("file_path", F.replace(F.replace("content", F.lit("Ok(())"), F.lit(safe)), F.lit("Ok(amount)"), F.lit("unsafe { invoke(transmute::<A, B>(x)) }")).alias("content"))
    return packs.scan_unsafe(df, keep=["file_path"]).select("file_path", "line_no", "id", "severity")


@query("unsafe_metrics", f"""WITH {FILES_SQL}, t AS (SELECT program, {UNSAFE_TEXT} AS body FROM texts)
 SELECT program, sum(len(string_split(regexp_replace(body, '\\n$', ''), chr(10))))::BIGINT AS total_lines, sum(len(regexp_extract_all(body, '\\bunsafe\\s*\\{{')))::BIGINT AS unsafe_blocks,
 sum(len(regexp_extract_all(body, '\\*(?:const|mut)\\s+\\w+')))::BIGINT AS raw_pointers, sum(len(regexp_extract_all(body, 'transmute\\s*[:<(]')))::BIGINT AS transmute_calls FROM t GROUP BY program""")
def unsafe_metrics(spark, sf):
    safe = "// SAFETY: checked\nunsafe { let q = p as *const u8; }"
    df = code_files(spark, sf).withColumn("content", F.replace(F.replace("content", F.lit("Ok(())"), F.lit(safe)), F.lit("Ok(amount)"), F.lit("unsafe { invoke(transmute::<A, B>(x)) }")))
    return packs.unsafe_metrics(df, ["program"]).select("program", "total_lines", "unsafe_blocks", "raw_pointers", "transmute_calls")


@query("exploit_lines", f"""WITH {FILES_SQL}, t AS (SELECT DISTINCT file_path, replace(content, 'Ok(amount)', 'amount + fee without checked') AS body FROM texts), {_line_sql(packs.EXPLOIT_LINES, 't', 'body', 'file_path')}
 SELECT file_path, CAST(line_no AS INTEGER) AS line_no, split_part(h, '|', 1) AS id FROM hit""")
def exploit_lines(spark, sf):
    df = code_files(spark, sf).select("file_path", F.replace("content", F.lit("Ok(amount)"), F.lit("amount + fee without checked")).alias("content")).distinct()
    return packs.scan_line_patterns(df, packs.EXPLOIT_LINES, keep=["file_path"]).select("file_path", "line_no", "id")


ARITH_TESTS = ", ".join(
    f"CASE WHEN regexp_matches(line, '{p}') AND NOT (contains(line, 'checked_') OR contains(line, 'saturating_')){' AND NOT ok' if k == 'UncheckedArithmetic' else ''} THEN '{k}' END" for k, _, p in packs.ARITHMETIC)


@query("scan_arithmetic", f"""WITH {FILES_SQL}, l AS (SELECT program, {' + '.join(f"(length(content) - length(replace(content, '{t}', ''))) // {len(t)}" for t in packs.CHECKED_CALLS)} >= 2 AS ok, unnest(string_split(content, chr(10))) AS line FROM texts),
 h AS (SELECT program, unnest(list_filter([{ARITH_TESTS}], lambda x: x IS NOT NULL)) AS kind FROM l WHERE trim(line) <> '' AND NOT starts_with(trim(line), '//'))
 SELECT program, kind, count(*) AS n FROM h GROUP BY ALL""")
def scan_arithmetic(spark, sf):
    return packs.scan_arithmetic(code_files(spark, sf), keep=["program"]).groupBy("program", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("mine_invariants", f"""WITH {FILES_SQL}, h AS (SELECT file_path, program, list_filter([{', '.join(f"CASE WHEN {sql_condition(t, 'content')} THEN '{p}|{e}' END" for p, c, t, e, conf, bad in packs.INVARIANTS)}], lambda x: x IS NOT NULL) AS v FROM texts),
 x AS (SELECT program, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM h) SELECT program, split_part(v, '|', 1) || '-' || i AS invariant_id, split_part(v, '|', 2) AS expression, count(*) AS n FROM x GROUP BY ALL""")
def mine_invariants(spark, sf):
    out = packs.mine_invariants(code_files(spark, sf), keep=["program"])
    return out.groupBy("program", "invariant_id", "expression").agg(F.count(F.lit(1)).alias("n"))


@query("scan_behaviour", """WITH t AS (SELECT page_id, 'app/' || replace(url, '://', '/node_modules/') AS path, html FROM pages),
 s AS (SELECT page_id, path, html, contains(html, 'track(') AND contains(html, 'href="/The"') AS theft, CAST(contains(html, '<li>') AS INTEGER) + CAST(contains(html, 'charset') AS INTEGER) + CAST(contains(html, 'www.') AS INTEGER) AS clip,
  CAST(contains(html, '%%%') AS INTEGER) + CAST(contains(html, '###') AS INTEGER) + CAST(contains(html, '&amp;') AS INTEGER) + CAST(contains(html, '$$$') AS INTEGER) AS obf FROM t),
 f AS (SELECT page_id, path, unnest(CASE WHEN theft THEN ['Critical'] ELSE list_filter([CASE WHEN clip >= 2 THEN 'High' END, CASE WHEN obf >= 3 THEN 'Medium' END], lambda x: x IS NOT NULL) END) AS severity FROM s
  WHERE NOT (len(string_split(regexp_replace(html, '\\n$', ''), chr(10))) <= 3 AND length(html) > 10000))
 SELECT page_id, regexp_extract(path, 'node_modules/((?:@[^/]+/)?[^/]+)', 1) AS package_name, severity FROM f""")
def scan_behaviour(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("app/"), F.replace("url", F.lit("://"), F.lit("/node_modules/"))).alias("file_path"), F.col("html").alias("content"))
    out = packs.scan_behaviour(p, keep=["page_id"], key_access=("track(",), network=('href="/The"',), clipboard=("<li>", "charset", "www."), obfuscation=("%%%", "###", "&amp;", "$$$"))
    return out.select("page_id", "package_name", "severity")


@query("drop_minified", "SELECT page_id FROM pages WHERE NOT (len(string_split(regexp_replace(html, '\\n$', ''), chr(10))) <= 3 AND length(html) > 10000)")
def drop_minified(spark, sf):
    return packs.drop_minified(table(spark, sf, "pages"), "html").select("page_id")


def _diff_sql(text):
    return ", ".join("CASE WHEN " + " OR ".join(f"contains({text}, '{t}')" for t in tokens) + f" THEN '{i}' END" for i, _, _, tokens in packs.RUNTIME_DIFFS)


@query("safe_patterns", f"WITH {FILES_SQL}, h AS (SELECT program, unnest(list_filter([{', '.join(f"CASE WHEN {sql_condition(t, 'content')} THEN '{n}' END" for n, t in packs.SAFE_PATTERNS.items())}], lambda x: x IS NOT NULL)) AS pattern FROM texts) SELECT program, pattern, count(*) AS n FROM h GROUP BY ALL")
def safe_patterns(spark, sf):
    return packs.safe_patterns(code_files(spark, sf), keep=["program"]).groupBy("program", "pattern").agg(F.count(F.lit(1)).alias("n"))


# What a warning takes from the compatibility score.
WARNING_SQL = {"TransactionOrderingDependency": 12, "ClockResolutionAssumption": 5, "ConcurrentAccountAccess": 8}
DIFF_POINTS = {"BREAKING": 15, "RISKY": 8, "INFO": 2}


def _warning_points(text):
    rules = [f"CASE WHEN {sql_condition(r['when'], text)} THEN {WARNING_SQL[r['name']]} ELSE 0 END" for r in packs.COMPATIBILITY]
    diffs = [f"CASE WHEN {' OR '.join(f"contains({text}, '{t}')" for t in tokens)} THEN {DIFF_POINTS.get(severity, 5)} ELSE 0 END" for _, _, severity, tokens in packs.RUNTIME_DIFFS]
    return " + ".join(rules + diffs)


@query("compatibility_warnings", f"WITH {FILES_SQL}, p AS (SELECT DISTINCT file_path, {_warning_points('content')} AS points FROM texts) SELECT file_path, CAST(greatest(0, 100 - points) AS INTEGER) AS compat_score FROM p WHERE points > 0")
def compatibility_warnings(spark, sf):
    """Score of each file with warnings."""
    files = distinct_files(spark, sf).select("file_path", "content")
    return scores.compat_score(packs.compatibility_warnings(files, keep=["file_path"]), ["file_path"]).select("file_path", F.col("compat_score").cast("int").alias("compat_score"))


@query("runtime_diffs", f"WITH {FILES_SQL}, h AS (SELECT program, unnest(list_filter([{_diff_sql('content')}], lambda x: x IS NOT NULL)) AS id FROM texts) SELECT program, id, count(*) AS n FROM h GROUP BY ALL")
def runtime_diffs(spark, sf):
    return packs.runtime_diffs(code_files(spark, sf), keep=["program"]).groupBy("program", "id").agg(F.count(F.lit(1)).alias("n"))


SYS_TESTS = ", ".join(
    f"CASE WHEN contains(content, '{t}') THEN '{name}|{t}|' || (1 + length(regexp_replace(content[1:strpos(content, '{t}') - 1], '[^\\n]', '', 'g'))) END" for name, tokens, _, _ in packs.SYSCALLS for t in tokens)


@query("syscall_usage", f"WITH {FILES_SQL}, h AS (SELECT file_path, unnest(list_filter([{SYS_TESTS}], lambda x: x IS NOT NULL)) AS u FROM texts) SELECT file_path, split_part(u, '|', 1) AS syscall, split_part(u, '|', 2) AS token, CAST(split_part(u, '|', 3) AS INTEGER) AS line_no FROM h")
def syscall_usage(spark, sf):
    return packs.syscall_usage(code_files(spark, sf), keep=["file_path"]).select("file_path", "syscall", "token", "line_no")


@query("unanswered_calls", f"""WITH {FILES_SQL}, l AS (SELECT DISTINCT file_path, content FROM texts), x AS (SELECT file_path, unnest(string_split(regexp_replace(content, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(content, '\\n$', ''), chr(10)), 1) AS n FROM l),
 e AS (SELECT * FROM x WHERE regexp_matches(line, 'invoke\\(|invoke_signed\\(|program::invoke') AND NOT starts_with(trim(line), '//')), v AS (SELECT file_path, n FROM x WHERE {sql_condition(packs.NEAR_CALL['evidence'], 'line')})
 SELECT file_path, CAST(n AS INTEGER) AS line_no FROM e WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.file_path = e.file_path AND v.n >= e.n - 10 AND v.n < e.n + 5)""")
def unanswered_calls(spark, sf):
    df = distinct_texts(spark, sf)
    return packs.unanswered_lines(df, packs.NEAR_CALL, keep=["file_path"]).select("file_path", "line_no")


# --- project context ------------------------------------------------------------------------------

FLAG_SQL = ", ".join(f"bool_or({sql_condition(t, 'content')}) AS {n}" for n, t in {**ctx.SIGNALS, **ctx.PROJECT_EVIDENCE}.items())
COUNT = lambda t: f"((length(content) - length(replace(content, '{t}', ''))) // {len(t)})"
TYPED = " + ".join(COUNT(f"{n}{m}") for n in ctx.TYPED_NAMES for m in (" <", "<"))
RAW = " + ".join(COUNT(f"{n}{m}") for n in ctx.RAW_NAMES for m in (" <", "<"))


@query("project_context", f"""WITH {FILES_SQL}, c AS (SELECT program, count(*) AS file_count, sum(CAST({sql_condition(ctx.FRAMEWORK, 'content')} AS INTEGER))::BIGINT AS framework_files, sum({TYPED})::BIGINT AS typed_uses, sum({RAW})::BIGINT AS raw_uses, {FLAG_SQL} FROM texts GROUP BY program)
 SELECT program, file_count, framework_files, typed_uses, raw_uses, round(typed_uses / (typed_uses + raw_uses), 6) AS typed_ratio, {', '.join(ctx.SIGNALS)}, {', '.join(ctx.PROJECT_EVIDENCE)} FROM c""")
def project_context(spark, sf):
    out = ctx.project_context(code_files(spark, sf))
    return out.select("program", "file_count", "framework_files", "typed_uses", "raw_uses", F.round("typed_ratio", 6).alias("typed_ratio"), *ctx.SIGNALS, *ctx.PROJECT_EVIDENCE)


FN_FLAGS = ", ".join(f"bool_or({sql_condition(t, 'content')}) AS {n}" for n, t in ctx.FUNCTION_SIGNALS.items())


@query("function_signals", f"""WITH {FILES_SQL}, n AS (SELECT program, content, unnest(list_distinct(regexp_extract_all(content, 'fn (\\w+)', 1))) AS fn_name FROM texts),
 a AS (SELECT program, fn_name, {FN_FLAGS} FROM n GROUP BY ALL) SELECT * FROM a WHERE {' OR '.join(ctx.FUNCTION_SIGNALS)}""")
def function_signals(spark, sf):
    return ctx.function_signals(code_files(spark, sf))
