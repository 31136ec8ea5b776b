import random

from pyspark.sql import functions as F

from auditlake.functions.numbers import grade
from auditlake.operators import aggregates, evaluate, lookups, scores
from auditlake.operators import findings as ops
from auditlake.rules.controls import SOC2

SCHEMA = ("program string, id string, vuln_type string, location string, function_name string, line_number int, severity int, "
          "confidence int, category string, description string, vulnerable_code string, seq long")


def make(spark, n=400, seed=1):
    rng = random.Random(seed)
    data = [
        ("hot" if rng.random() < 0.5 else f"p{rng.randrange(4)}", f"SOL-{rng.randrange(1, 6):03d}", rng.choice("xyz"), f"src/{rng.randrange(5)}.rs",
         rng.choice(["", "f", "g"]), rng.choice([0, 0, 3, 9]), rng.randrange(1, 7), rng.randrange(10, 99), "Heuristic", "d", "code", i)
        for i in range(n)
    ]
    return spark.createDataFrame(data, SCHEMA), data


def test_dedupe_best_keeps_highest_then_earliest(spark, rows):
    df, data = make(spark)
    best = {}
    for r in data:
        key = (r[0], r[2], r[3], ("L", r[5]) if r[5] > 0 else ("F", r[4]))
        if key not in best or r[7] > best[key][7]:
            best[key] = r
    once = ops.dedupe_best(df, scope=["program"])
    assert rows(once, "seq") == sorted(((r[11],) for r in best.values()), key=repr)
    assert rows(ops.dedupe_best(once, scope=["program"]), "seq") == rows(once, "seq")


def test_dedupe_first_and_fingerprint(spark, rows):
    df, data = make(spark)
    first = {}
    for r in data:
        first.setdefault((r[1], r[3]), r[11])
    assert rows(ops.dedupe_first(df), "seq") == sorted(((v,) for v in first.values()), key=repr)


def test_cap_by_severity(spark):
    df, data = make(spark, 2000)
    kept = ops.cap_by_severity(df, by=("program",)).collect()
    limit = {5: 15, 4: 20, 3: 15, 2: 10, 1: 5}
    groups = {}
    for r in data:
        groups.setdefault((r[0], r[6]), []).append(r)
    expected = sorted(x[11] for (p, s), g in groups.items() for x in sorted(g, key=lambda r: (-r[7], r[11]))[: limit.get(s, 15)])
    assert sorted(r["seq"] for r in kept) == expected


def test_suppress_and_categories(spark):
    df, data = make(spark)
    left = ops.suppress(df, ids=["SOL-001"], paths=["4.rs"], functions=["g", "f*"]).collect()
    assert sorted(r["seq"] for r in left) == [r[11] for r in data if r[1] != "SOL-001" and "4.rs" not in r[3] and r[4] not in ("g", "f")]
    assert ops.filter_categories(df, ["Heuristic"], ["Heuristic"]).count() == 0
    assert ops.filter_categories(df).count() == len(data)


def test_root_cause_note_and_places(spark):
    df, data = make(spark, 300)
    notes = {(r["program"], r["id"]): r["description"] for r in ops.annotate_root_cause(df, scope=["program"]).collect()}
    groups = {}
    for r in data:
        groups.setdefault((r[0], r[1]), []).append(r)
    for key, g in groups.items():
        assert notes[key] == (f"d [found in {len(g)} locations]" if len(g) > 1 else "d")
    rows = ops.root_cause_locations(df, scope=["program"]).count()
    assert rows == sum(len(g) - 1 for g in groups.values())


def test_non_program_paths(spark):
    df = spark.createDataFrame([("main.rs",), ("src/main.rs",), ("tests/a.rs",), ("lib.rs",), ("x_bench.rs",)], "location string")
    assert [r[0] for r in ops.drop_non_program(df).collect()] == ["src/main.rs", "lib.rs"]


def test_protocol_score_and_grade(spark):
    data = [(0, 0, 0, 0, True, "Immutable", 0, 0, 0), (1, 2, 0, 1, False, "Multisig", 1, 3, 9), (9, 0, 0, 0, True, "Unknown", 0, 0, 0)]
    df = spark.createDataFrame(data, "critical int, high int, medium int, low int, source_verified boolean, authority_kind string, threshold int, signers int, guard_risk int")
    out = df.select(scores.protocol_score().alias("s")).withColumn("g", grade(F.col("s"))).collect()
    assert [(r["s"], r["g"]) for r in out] == [(100, "A+"), (100 - 25 - 30 - 2 - 15 - 10 - 2, "F"), (0, "F")]


def test_guard_risk_case(spark):
    df = spark.createDataFrame([("m", "Critical", "KnownMalicious"), ("n", "Low", "Typosquat")], "manifest string, severity string, category string")
    assert dict(scores.guard_risk(df, ["manifest"]).collect()) == {"m": 50, "n": 2}


def test_confirmations_ignore_self_and_repeats(spark):
    a = spark.createDataFrame([("t", "x"), ("u", "y")], "target string, analyst string")
    c = spark.createDataFrame([("t", "x"), ("t", "z"), ("t", "z"), ("t", "w")], "target string, analyst string")
    who = spark.createDataFrame([("x", 5000), ("y", 9990)], "analyst string, reputation_bps int")
    done = scores.confirm_assessments(a, c, who)
    assert sorted((r["target"], r["confirmations"], r["confidence"], r["status"]) for r in done.collect()) == [
        ("t", 2, 45, "Confirmed"), ("u", 0, 49, "Pending")]
    assert dict(scores.reputation_after(done, who).collect()) == {"x": 5200, "y": 9990}


def test_consensus_cases(spark):
    v = spark.createDataFrame(
        [("a", "m1", "CONFIRMED", 0.9), ("a", "m2", "CONFIRMED", 0.8), ("a", "m3", "REJECTED", 0.5),
         ("b", "m1", "CONFIRMED", 0.9), ("b", "m2", "REJECTED", 0.9), ("c", "m1", "REJECTED", 0.9), ("c", "m2", "UNCERTAIN", 0.1), ("c", "m3", "UNCERTAIN", 0.1)],
        "finding_id string, model string, verdict string, confidence double")
    w = spark.createDataFrame([("m1", 1.0)], "model string, weight double")
    out = {r["finding_id"]: (r["verdict"], r["should_report"]) for r in aggregates.consensus(v, w).collect()}
    assert out == {"a": ("CONFIRMED", True), "b": ("UNCERTAIN", False), "c": ("UNCERTAIN", False)}


def test_controls_pass_and_fail(spark):
    f = spark.createDataFrame([("p", "SOL-001"), ("p", "SOL-001"), ("q", "SOL-999")], "program string, id string")
    out = {(r["program"], r["control_id"]): (r["status"], r["n_findings"]) for r in lookups.control_status(f, SOC2, ["program"]).collect()}
    assert out[("p", "CC6.1")] == ("Fail", 2) and out[("q", "CC6.1")] == ("Pass", 0) and len(out) == 12


def test_enrich_fills_only_empty_fields(spark):
    f = spark.createDataFrame([("SOL-001", "", "own"), ("SOL-777", "", "")], "id string, attack_scenario string, prevention string")
    kb = spark.createDataFrame([(2, ["SOL-001"], "late"), (1, ["SOL-001", "SOL-002"], "first")], "pos int, detector_ids array<string>, description string")
    out = lookups.enrich(f, kb, {"attack_scenario": "description", "prevention": "description"}).collect()
    assert sorted(map(tuple, out)) == [("SOL-001", "first", "own"), ("SOL-777", "", "")]


def test_cpi_risk_truncates_each_step(spark):
    e = spark.createDataFrame([("a", "b", "AnchorCPI"), ("a", "c", "RawInvoke"), ("a", "gone", "RawInvoke")], "caller string, callee string, call_type string")
    n = spark.createDataFrame([("b", 10, False, True), ("c", None, True, False)], "program_id string, security_score int, verified boolean, is_upgradeable boolean")
    assert {r["callee"]: r["risk"] for r in lookups.cpi_risk(e, n).collect()} == {"b": int(int(int(30 * 1.3) * 1.2) * 1.4), "c": 80}


def test_transactions(spark):
    safe_id, scored, unknown = "S" * 32, "T" * 32, "U" * 32
    t = spark.createDataFrame([(1, safe_id), (1, scored), (2, unknown), (2, "bad"), (3, "T" * 33)], "tx_id int, program_id string")
    board = spark.createDataFrame([(scored, 95), ("T" * 33, 10)], "program_id string, score int")
    out = {r["tx_id"]: (r["overall_risk"], r["is_safe"]) for r in lookups.assess_transactions(t, spark.createDataFrame([(safe_id,)], "program_id string"), board).collect()}
    assert out == {1: (2, True), 2: (50, False), 3: (90, False)}


def test_evaluate_zero_guards(spark):
    f = spark.createDataFrame([], "program string, id string, severity int, confidence int, function_name string")
    p = spark.createDataFrame([("a", "EXPLOITED", ["SOL-001"], False)], "program string, category string, expected_detections array<string>, semantic_exploit boolean")
    r = evaluate.evaluate(f, p).collect()[0]
    assert (r["tp"], r["precision"], r["recall"], r["f1"], r["static_exploited"]) == (0, 0.0, 0.0, 0.0, 1)


def test_coverage_bitmaps(spark):
    runs = spark.createDataFrame([(1, bytearray([0, 3, 0, 255])), (2, bytearray([0, 4, 1, 0]))], "run int, coverage binary")
    hits = aggregates.bitmap_bytes(runs).withColumn("g", F.lit(1))
    out = aggregates.coverage_union(hits, ["g"], 4).collect()[0]
    assert (out["covered"], out["any_bits"], out["coverage_pct"]) == (3, 255, 75.0)
    assert sorted((r["run"], r["new_places"]) for r in aggregates.new_coverage(hits, ["g"]).collect()) == [(1, 2), (2, 1)]


def test_detector_that_fails_while_it_runs(spark):
    from auditlake.plans.detectors import Detector, DetectorSet

    rows = spark.createDataFrame([(1, 4, 50, 1)], "n int, severity int, confidence int, seq int")
    fails = Detector("fails", "1", lambda df: df.withColumn("n", F.raise_error(F.lit("no")).cast("int")))
    found, errors = DetectorSet([fails, Detector("works", "1", lambda df: df)]).run(rows)
    assert [r["detector"] for r in found.collect()] == ["works"]
    assert [r["detector"] for r in errors.collect()] == ["fails"]
