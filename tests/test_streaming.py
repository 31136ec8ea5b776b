"""Streams give what the batch operators give, over several batches and when a batch is run again."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.operators.admission import FULL, UNCHANGED, Limits, bucket_state, token_bucket, value
from auditlake.operators.monitor import authority_changes
from auditlake.plans.scan import raw_findings
from auditlake.sources.telemetry import read_stream
from auditlake.streaming import jobs
from auditlake.streaming.keyed import keyed_state

T0 = dt.datetime(2024, 1, 1)


def batches(spark, tmp_path, data, schema, n):
    """Write the rows as n files in time order, to be read one file per batch."""
    folder = str(tmp_path / "in")
    size = (len(data) + n - 1) // n
    for i in range(n):
        spark.createDataFrame(data[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
        import time

        time.sleep(1.1)  # file sources order files by modification time
    return read_stream(spark, folder, schema, files_per_trigger=1)


def test_authority_watch_equals_batch(spark, tmp_path, rows):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.5 else f"p{rng.randrange(3)}", rng.choice(["a", "b", None]), T0 + dt.timedelta(seconds=i), i) for i in range(90)]
    schema = "program_id string, authority string, detected_at timestamp, n int"
    stream = batches(spark, tmp_path, data, schema, 3)
    root = str(tmp_path / "job")
    jobs.watch_authority(stream, root, order=("detected_at", "n")).awaitTermination()
    got = spark.read.parquet(f"{root}/output")
    assert got.select("batch").distinct().count() >= 2
    want = authority_changes(spark.createDataFrame(data, schema), order=("detected_at", "n"))
    cols = ("program_id", "n", "event_type", "previous_authority", "new_authority")
    assert rows(got, *cols) == rows(want, *cols)
    alerts = jobs.alerts(got, ["mail", "chat"])
    assert alerts.count() == 2 * got.filter("event_type <> 'FirstSeen'").count()


def fold(data, rate, burst):
    state, out = {}, {}
    for key, ts, seq in sorted(data, key=lambda r: (r[1], r[2])):
        tokens, last = state.get(key, (burst, ts))
        tokens = min(burst, tokens + (ts - last).total_seconds() * rate)
        ok = tokens >= 1.0
        state[key] = (tokens - 1.0 if ok else tokens, ts)
        out[seq] = ok
    return out


def requests(n, seed):
    rng = random.Random(seed)
    at, data = 0.0, []
    for i in range(n):
        at += rng.choice([0.125, 0.25, 0.5, 4.0])
        data.append(("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", T0 + dt.timedelta(seconds=at), i))
    return data


def test_token_bucket_equals_fold(spark):
    data = requests(800, 5)
    df = spark.createDataFrame(data, "key string, ts timestamp, seq int").repartition(6)
    want = fold(data, 0.5, 3.0)
    assert 0 < sum(want.values()) < len(want)
    out = token_bucket(df, 0.5, 3.0)
    assert {r["seq"]: r["admitted"] for r in out.collect()} == want


def test_admission_keeps_state_between_batches(spark, tmp_path):
    data = requests(150, 6)
    schema = "key string, ts timestamp, seq int"
    stream = batches(spark, tmp_path, data, schema, 3)
    root = str(tmp_path / "job")
    jobs.admit(stream, root, 0.5, 3.0, idle_seconds=3600.0).awaitTermination()
    got = {r["seq"]: r["admitted"] for r in spark.read.parquet(f"{root}/output").collect()}
    assert got == fold(data, 0.5, 3.0)


def test_a_busy_key_spans_tasks(spark):
    """The busy key never idles, so no task but the first knows its bucket; keys and other columns may be null."""
    rng = random.Random(8)
    at, data = 0, []
    for i in range(3000):
        at += rng.choice([100_000, 250_000, 400_000])
        data.append((None if rng.random() < 0.7 else rng.randrange(5), T0 + dt.timedelta(microseconds=at), i, 9007199254740993 if i % 2 else None))
    df = spark.createDataFrame(data, "key long, ts timestamp, seq int, big long").repartition(5)
    for rate, burst in ((0.9, 4.0), (3.0, 1.0), (1 / 3, 7.5)):
        exact = Limits.of(rate, burst)
        state, want = {}, {}
        for key, ts, seq, _ in data:
            t = int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 10**6 + 0.5) * exact.scale
            want[seq], state[key] = exact.after(state.get(key, FULL), t)
        assert 0 < sum(want.values()) < len(want)
        out = token_bucket(df, rate, burst)
        assert {r["seq"]: r["admitted"] for r in out.collect()} == want
        assert {r["seq"]: r["big"] for r in out.collect()} == {i: big for _, _, i, big in data}


def test_nullable_keys_and_times(spark):
    data = [(None, T0 + dt.timedelta(seconds=i), i) for i in range(6)] + [(1, None, 6), (None, None, 7), (1, T0, 8)]
    got = {r["seq"]: (r["admitted"], r["tokens"]) for r in token_bucket(spark.createDataFrame(data, "key long, ts timestamp, seq int"), 1e-6, 2.0).collect()}
    assert [got[i][0] for i in range(9)] == [True, True, False, False, False, False, False, False, True] and got[6][1] is None and got[8][1] == 1.0
    assert token_bucket(spark.createDataFrame([], "key long, ts timestamp, seq int"), 1.0, 2.0).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.lists(st.integers(0, 60), max_size=30), st.lists(st.integers(-300, 40), min_size=1, max_size=20))
def test_step_functions_equal_the_fold(token, burst, gaps, starts):
    limits = Limits(1, token, burst * token)
    steps, t = list(UNCHANGED), 0
    times = []
    for gap in gaps:
        t += gap
        times.append(t)
        steps = limits.advance(steps, t, times[0])
    for start in [*starts, FULL]:
        v = min(start, times[0] if times else 0)
        end = v
        for t in times:
            _, end = limits.after(end, t)
        assert value(steps, v) == end


def test_step_functions_stay_small():
    for burst in (1, 4, 20):
        rng, limits, steps, t = random.Random(burst), Limits(1, 1000, burst * 1000), list(UNCHANGED), 0
        for i in range(3000):
            t += rng.randint(0, 700)
            top = t if i == 0 else top
            steps = limits.advance(steps, t, top)
            assert len(steps) <= 2 * burst + 20


def test_admission_continues_from_a_state(spark):
    data = requests(400, 9)
    df = spark.createDataFrame(data, "key string, ts timestamp, seq int")
    want = fold(data, 0.5, 3.0)
    early = token_bucket(df.where("seq < 150"), 0.5, 3.0).cache()
    late = token_bucket(df.where("seq >= 150"), 0.5, 3.0, state=bucket_state(early))
    assert {r["seq"]: r["admitted"] for r in early.unionByName(late).collect()} == want


def test_idle_buckets_are_dropped(spark, tmp_path):
    """A bucket that is dropped starts full again; one with a later request stays."""
    minutes = lambda *at: [T0 + dt.timedelta(minutes=m) for m in at]
    times = [minutes(0, 0, 0), minutes(30, 90, 90), minutes(95, 96, 97)]
    keys = [["a", "a", "b"], ["b", "c", "c"], ["a", "b", "c"]]
    data = [(k, t, 3 * i + j) for i, (ks, ts) in enumerate(zip(keys, times, strict=True)) for j, (k, t) in enumerate(zip(ks, ts, strict=True))]
    stream = batches(spark, tmp_path, data, "key string, ts timestamp, seq int", 3)
    root = str(tmp_path / "job")
    jobs.admit(stream, root, 1e-6, 1.0, idle_seconds=3600.0, late="1 minute").awaitTermination()
    got = {r["seq"]: r["admitted"] for r in spark.read.parquet(f"{root}/output").collect()}
    # a (last at 0) was dropped when the watermark reached minute 89; b (last at 30) was not
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: False}


def test_session_settings_come_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with keyed_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before


def test_scan_stream_replaces_old_findings(spark, tmp_path, rows):
    bad = "pub fn take(ctx: Context<A>) {\n    invoke(&ix, &[a])?;\n}\n"
    schema = "program string, file_path string, file_name string, content string"
    data = [("p", "x.rs", "x.rs", bad), ("p", "y.rs", "y.rs", bad), ("p", "x.rs", "x.rs", "pub fn idle() {\n}\n")]
    stream = batches(spark, tmp_path, data, schema, 3)
    root = str(tmp_path / "job")
    jobs.scan_stream(stream, root).awaitTermination()
    got = jobs.current_findings(spark, root)
    want = raw_findings(spark.createDataFrame([data[1], data[2]], schema))
    assert rows(got, "file_path", "id") == rows(want, "file_path", "id") and got.count() > 0


def test_findings_meet_only_replaced_scans(spark, tmp_path, rows):
    root = str(tmp_path / "job")
    found = [(0, "x", "A"), (0, "y", "A"), (0, None, "A"), (1, "x", "B"), (2, "z", "C"), (3, "y", "D")]
    scanned = [(0, "x"), (0, "y"), (0, None), (1, "x"), (2, "z"), (2, "x")]  # batch 3 has no files yet
    spark.createDataFrame(found, "batch int, file_path string, id string").write.partitionBy("batch").parquet(f"{root}/findings")
    spark.createDataFrame(scanned, "batch int, file_path string").write.partitionBy("batch").parquet(f"{root}/files")
    got = jobs.current_findings(spark, root)
    assert got.columns == ["file_path", "id"] and rows(got, "file_path", "id") == [("y", "A"), ("z", "C")]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString() and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_scoreboard_and_dedupe(spark, tmp_path):
    data = [("a", 10, T0), ("b", 50, T0), ("a", 90, T0 + dt.timedelta(seconds=5)), ("b", 1, T0 - dt.timedelta(seconds=5))]
    schema = "program string, score int, ts timestamp"
    stream = batches(spark, tmp_path, data, schema, 2)
    root = str(tmp_path / "job")
    jobs.upsert_scoreboard(stream, root).awaitTermination()
    last = spark.read.parquet(f"{root}/state").filter("batch = 1")
    assert {r["program"]: r["score"] for r in last.collect()} == {"a": 90, "b": 50}
    deduped = jobs.dedupe_stream(stream, ["program"])
    out = str(tmp_path / "dedupe")
    deduped.writeStream.format("parquet").option("checkpointLocation", out + "-c").option("path", out).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 2
