import random

import pyarrow as pa
from pyspark.sql import functions as F

from auditlake.functions.numbers import band
from auditlake.operators import aggregates, monitor, vectors


def test_authority_changes(spark):
    data = [("p", 1, "a"), ("p", 2, "a"), ("p", 3, None), ("p", 4, None), ("p", 5, "b"), ("q", 1, None), ("q", 2, None)]
    df = spark.createDataFrame(data, "program_id string, detected_at int, authority string")
    out = {(r["program_id"], r["detected_at"]): r["event_type"] for r in monitor.authority_changes(df).collect()}
    assert out == {("p", 1): "FirstSeen", ("p", 3): "Revoked", ("p", 5): "Transferred", ("q", 1): "FirstSeen"}
    state = {r["program_id"]: (r["current_authority"], r["n_events"]) for r in monitor.current_authority(df).collect()}
    assert state == {"p": ("b", 5), "q": (None, 2)}


def test_lag_fallback_and_cap(spark):
    data = [("v", 1, 100, 2, 2), ("v", 2, 101, 2, 2), ("v", 3, None, 2, 1), ("v", 4, 500, 0, 1), ("v", 5, 400, 1, 1)]
    df = spark.createDataFrame(data, "validator string, slot int, block_time int, num_slots int, sample_period_secs int")
    out = {r["slot"]: r["lag_ms"] for r in monitor.verification_lag(df).collect()}
    assert out == {2: 600, 3: 100, 4: 0, 5: 5000}


def test_skip_stress_and_bands(spark):
    data = [("v", i, 1, 3000 if i > 5 else 0) for i in range(1, 16)]
    df = spark.createDataFrame(data, "validator string, ts int, num_slots int, num_transactions int")
    assert monitor.skip_rate(df).collect()[0]["skip_rate"] == 0.0
    r = monitor.stress(df).collect()[0]
    assert (r["stress"], r["severity"]) == (60.0, None)
    got = [r[0] for r in spark.range(5).select(band(F.col("id") * 500, 499).alias("b")).orderBy("b").collect()]
    assert sorted(x or "" for x in got) == ["", "Critical", "Critical", "High", "Medium"]


def test_pool_invariants(spark):
    good = ("a", 1000, 100, 200, 10, 10, 30, 5, 5)
    bad = ("b", 10, 100, 90, 10, 0, 20000, 0, 5)
    df = spark.createDataFrame([good, bad], "pool string, total_deposits long, total_borrows long, total_collateral long, total_assets long, total_shares long, fee_bps int, reserve_x long, reserve_y long")
    out = sorted(map(tuple, monitor.check_invariants(df, monitor.pool_specs(), ["pool"]).collect()))
    assert out == [("b", n) for n in sorted(["deposits_cover_borrows", "collateral_ratio", "health_factor", "fee_bound", "zero_share_mint", "reserves_positive"])]


def test_share_price_never_falls(spark):
    df = spark.createDataFrame([("p", 1, 100, 10), ("p", 2, 220, 20), ("p", 3, 210, 20), ("p", 4, 300, 28)], "pool string, t int, assets long, shares long")
    assert [r["t"] for r in monitor.monotone(df, "pool", ["t"], "assets", "shares").collect()] == [3]
    assert [r["t"] for r in monitor.bounded_change(df, "pool", ["t"], "assets", 5000).collect()] == [2]


def test_interval_profile(spark):
    df = spark.createDataFrame([("g", 2**63 - 1, 2**62), ("g", 5, 0), ("h", 4, 2), ("h", 6, 3)], "k string, a long, b long")
    out = {r["k"]: r for r in aggregates.interval_profile(df, ["k"], "a", "b").collect()}
    assert out["g"]["may_overflow"] and out["g"]["div_by_zero"] and out["g"]["may_negative"]
    assert not (out["h"]["may_overflow"] or out["h"]["div_by_zero"] or out["h"]["must_overflow"]) and out["h"]["div"]["hi"] == 3


def test_nearest_patterns_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    pats = [(f"p{i}", [1.0 if j == i else 0.0 for j in range(12)]) for i in range(12)]
    vecs = [(i, [0.9 if j == i else 0.1 for j in range(12)]) for i in range(12)] + [(99, [0.0] * 12)]
    p = spark.createDataFrame(pats, "pattern string, embedding array<double>")
    v = spark.createDataFrame(vecs, "id int, embedding array<double>")
    want = {i: f"p{i}" for i in range(12)}
    assert {r["id"]: r["pattern"] for r in vectors.nearest_patterns(v, p, "id").collect()} == want


def test_embedding_is_normalised_and_positional(spark):
    df = spark.createDataFrame([(1, "invoke transfer\nowner"), (2, "")], "n int, content string")
    out = {r["n"]: r["embedding"] for r in vectors.embed(df).collect()}
    assert abs(sum(x * x for x in out[1]) - 1) < 1e-9 and out[1][0] > out[1][7] > 0 and len(out[1]) == 128
    assert set(out[2]) == {0.0}


def test_pool_history(spark):
    """(pool, at, reserves, lp, dead, rewards): products beyond 64 bits, a null pool, one snapshot that breaks each rule."""
    big = 4_000_000_000_000_000_000
    rows = [
        ("ok", 0, big, big // 2, 10, 0), ("ok", 10, big // 2, big // 4, 10, 50), ("ok", 20, big // 2 + 9, big // 4, 11, 50),
        ("lp", 0, big, 1000, 1, 0), ("lp", 5, big + 10**16, 1001, 1, 0), ("dead", 0, 5, 5, 0, 0), ("less", 0, 5, 5, 3, 0), ("less", 1, 5, 5, 2, 0),
        ("paid", 0, 5, 5, 1, 0), ("paid", 10, 5, 5, 1, 51), (None, 0, 5, 5, 1, 0), (None, 7, 5, 5, 1, 36), ("empty", 0, 0, 0, 0, 0),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "pool string, at long, total_reserves long, total_lp long, dead_shares long, total_rewards long, reward_rate long").repartition(4)
    for bucket in (None, F.floor(F.col("at") / 6)):
        got = monitor.check_history(df, "pool", ["at"], ["pool", "at"], bucket=bucket)
        assert {tuple(r) for r in got.collect()} == {("lp", 5, "lp_proportional"), ("dead", 0, "dead_shares"), ("less", 1, "dead_shares"), ("paid", 10, "emission_bound"), (None, 7, "emission_bound")}


def test_nearest_lines(spark, monkeypatch):
    """Every line scored alone, in blocks of lines and patterns of any size; the first of equal lines wins."""
    rng = random.Random(3)
    word = lambda: rng.choice(["invoke", "authority", "lamports", "x", "é", "+", "checked_add", "//"])
    texts = ["\n".join(" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 9))) for _ in range(30)] + [None, "", "\n", "// invoke x", "invoke x\ninvoke x\n"]
    patterns = [("a", "invoke authority"), ("b", "x x lamports"), ("c", ""), ("d", "invoke x")]
    line = lambda t: vectors.line_vectors(pa.array([t]))[0]
    want = set()
    for k, text in enumerate(texts):
        for name, like in patterns:
            best = None
            for n, code in enumerate((text or "").removesuffix("\n").split("\n"), 1):
                score = round(float(line(code) @ line(like)), 9)
                if text and code.strip() and not code.strip().startswith("//") and score > (best[1] if best else 0.5):
                    best = (n, score)
            if best:
                want.add((k, name, best[0], round(best[1], 6)))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string").repartition(3)
    likes = spark.createDataFrame(patterns, "pattern string, text string")
    for lines, most in ((8192, 4096), (3, 2)):
        monkeypatch.setattr(vectors, "LINES", lines)
        monkeypatch.setattr(vectors, "PATTERNS", most)
        got = vectors.nearest_lines(df, likes, "id").collect()
        assert {(r["id"], r["pattern"], r["line_no"], round(r["similarity"], 6)) for r in got} == want and len(got) == len(want) > 30
