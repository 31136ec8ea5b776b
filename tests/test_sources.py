import json

from pyspark.sql import functions as F

from auditlake.plans.guard import guard_findings, guard_report
from auditlake.sources import manifests, reports
from auditlake.sources.corpus import (
    explode_lines, extract_structs, extract_units, join_context, read_corpus, units_with_context, validate_path, validate_source, with_snippet,
)


def test_corpus_reader(spark, tmp_path):
    root = tmp_path / "programs"
    (root / "a" / "src").mkdir(parents=True)
    (root / "a" / "src" / "lib.rs").write_text("pub fn x() {}\n")
    (root / "a" / "src" / "notes.md").write_text("no")
    (root / "top.rs").write_text("")
    out = {r["file_name"]: (r["program"], r["content"]) for r in read_corpus(spark, str(root)).collect()}
    assert out == {"lib.rs": ("a", "pub fn x() {}\n"), "top.rs": ("programs", "")} or set(out) == {"lib.rs"}
    assert out["lib.rs"][0] == "a"


def test_lines_and_snippets(spark):
    df = spark.createDataFrame([("f", "a\n// b\n\nc\n")], "file string, content string")
    got = [(r["line_no"], r["line"], r["is_blank"], r["is_comment"]) for r in explode_lines(df).collect()]
    assert got == [(1, "a", False, False), (2, "// b", False, True), (3, "", True, False), (4, "c", False, False)]
    snip = {r["line_no"]: r["snippet"] for r in with_snippet(df, 1).collect()}
    assert snip[1] == "a\n// b" and snip[4] == "\nc"


def test_source_guard(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "  "), (3, "x" * 50), (4, "a\u0000b"), (5, ""), (6, None), (7, "é" * 11)], "n int, content string")
    good, bad = validate_source(df, limit=20)
    assert sorted(r["n"] for r in good.collect()) == [1, 2, 5]
    assert {r["n"]: r["reason"] for r in bad.collect()} == {3: "too long", 4: "binary", 6: "missing", 7: "too long"}


def test_path_guard(spark):
    df = spark.createDataFrame([(1, "a/b.rs"), (2, "a/../b.rs"), (3, "/a/b/c.rs"), (4, "a//./b/c.rs"), (5, None), (6, "./a/b/c.rs")], "n int, file_path string")
    good, bad = validate_path(df, depth=3)
    assert sorted(r["n"] for r in good.collect()) == [1, 4]
    assert {r["n"]: r["reason"] for r in bad.collect()} == {2: "traversal", 3: "too deep", 5: "missing", 6: "too deep"}


def test_last_struct_of_a_name_counts(spark):
    code = "pub struct Deposit {\n z: u8 }\npub struct DepositLog {\n q: u8 }\npub struct Deposit {\n a: u8 }\npub fn go(ctx: Context<Deposit>) {\n}\n"
    files = spark.createDataFrame([("f.rs", code)], "file_path string, content string")
    keep = ["file_path"]
    one = units_with_context(files, keep=keep).collect()
    two = join_context(extract_units(files, keep=keep), extract_structs(files, keep=keep)).collect()
    assert [r["code"] for r in one] == [r["code"] for r in two]
    assert "a: u8" in one[0]["accounts_struct"]


CARGO = """[package]
name = "app"
version = "0.1.0"

[dependencies]
anchor-lang = "0.29.0"
"quoted" = "1"
pathed = { path = "../../../../x" }
borsh.workspace = true

[target.'cfg(unix)'.dependencies]
unixy = { version = "2", git = "https://github.com/solana-labs/x" }

[dev-dependencies.tabled]
version = "3.1"
git = "https://github.com/nobody/tabled"

[profile.release]
overflow-checks = true
"""


def test_cargo_manifest(spark):
    df = spark.createDataFrame([("c/Cargo.toml", CARGO)], "file_path string, content string")
    deps = manifests.read_cargo_manifests(df)
    got = {r["name"]: (r["section"], r["version"], r["path"], r["git"]) for r in deps.collect()}
    assert got == {
        "anchor-lang": ("dependencies", "0.29.0", None, None), "quoted": ("dependencies", "1", None, None),
        "pathed": ("dependencies", "*", "../../../../x", None), "borsh": ("dependencies", "*", None, None),
        "unixy": ("dependencies", "2", None, "https://github.com/solana-labs/x"),
        "tabled": ("dev-dependencies", "3.1", None, "https://github.com/nobody/tabled")}
    assert manifests.framework_version(deps).collect()[0]["framework_version"] == "0.29.0"


def test_guard_plan(spark):
    pkg = json.dumps({"name": "app", "dependencies": {"@solana/web3.js": "^1.95.6", "solana/web3.js": "1"}, "scripts": {"preinstall": "WGET http://x"}})
    npm = spark.createDataFrame([("package.json", pkg), ("node_modules/x/package.json", pkg), ("broken/package.json", "{")], "file_path string, content string")
    cargo = spark.createDataFrame([("c/Cargo.toml", CARGO)], "file_path string, content string")
    adv = spark.createDataFrame([("A", "@Solana/web3.js", "npm", ["1.95.6", "1.95.7"], "critical", "backdoor")],
                                "id string, package string, ecosystem string, affected_versions array<string>, severity string, title string")
    found = guard_findings(npm, cargo, adv)
    got = {(r["manifest"], r["category"], r["severity"]) for r in found.collect()}
    assert ("package.json", "KnownMalicious", "Critical") in got and ("package.json", "Typosquat", "High") in got
    assert ("package.json", "SuspiciousBehavior", "High") in got and not any("node_modules" in m for m, _, _ in got)
    assert {r["manifest"]: r["guard_risk"] for r in guard_report(found).collect()} == {"package.json": 80, "c/Cargo.toml": 7}


def test_advisory_and_finding_files(spark, tmp_path):
    (tmp_path / "adv.json").write_text(json.dumps({"advisories": [{"id": "A", "package": "p", "ecosystem": "npm", "affected_versions": ["*"], "severity": "high"}]}))
    assert manifests.read_advisories(spark, str(tmp_path / "adv.json")).select("id", "package", "affected_versions").collect()[0][2] == ["*"]
    (tmp_path / "f.json").write_text(json.dumps([{"id": "SOL-001", "severity": 5}, {"id": "SOL-002", "severity": 4, "confidence": 90}]))
    assert sorted((r["id"], r["confidence"]) for r in reports.read_findings(spark, str(tmp_path / "f.json")).collect()) == [("SOL-001", 50), ("SOL-002", 90)]


def test_sarif_splits_large_runs(spark):
    df = spark.range(50).select(F.lit("p").alias("program"), F.concat(F.lit("SOL-"), (F.col("id") % 3).cast("string")).alias("id"), F.lit(4).alias("severity"),
                                F.lit("d \"q\"").alias("description"), F.lit("a.rs").alias("location"), F.lit(0).alias("line_number"), F.lit("v").alias("vuln_type"), F.col("id").alias("seq"))
    docs = reports.to_sarif(df, ["program"], F.col("seq"), rows=10).collect()
    assert len(docs) > 1 and sum(len(json.loads(d["document"])["runs"][0]["results"]) for d in docs) == 50
    first = json.loads(docs[0]["document"])["runs"][0]["results"][0]
    assert first["level"] == "error" and first["rank"] == 7 and first["message"]["text"] == 'd "q"'


def test_folder_of_findings_is_not_written_by_every_task(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("P"), (F.col("id") % 5).cast("string")).alias("program"), F.col("id")).repartition(8)
    reports.write_findings(rows, str(tmp_path / "out"), by="program")
    files = list((tmp_path / "out").rglob("*.parquet"))
    assert len(files) == 5
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400


def test_context_join_stays_where_files_lie(spark):
    """Files that lie together by path are not moved again for their structs; the last struct of a name counts."""
    text = "pub struct A<'info> {\n  x: u8\n}\npub struct A<'info> {\n  y: u8\n}\nfn f(c: Context<A>) {\n}\nfn g(c: Context<B>) {\n}\n"
    files = spark.createDataFrame([("p", "x.rs", text), ("p", None, text)], "program string, file_path string, content string").repartition(3, "file_path")
    keep = ["program", "file_path"]
    out = join_context(extract_units(files, keep=keep), extract_structs(files, keep=keep))
    got = {(r["file_path"], r["fn_name"]): r["code"] for r in out.collect()}
    assert len(got) == 4 and "y: u8" in got["x.rs", "f"] and "x: u8" not in got["x.rs", "f"]
    assert all(got[k].startswith("fn ") for k in got if k != ("x.rs", "f"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = join_context(extract_units(files, keep=keep), extract_structs(files, keep=keep))
        assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
