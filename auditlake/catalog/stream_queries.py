"""Streaming jobs run to the end of the given tables, and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditlake.catalog.base import query, table
from auditlake.catalog.corpus import code_files
from auditlake.catalog.monitor_queries import WATCH_SQL
from auditlake.operators.admission import token_bucket
from auditlake.session import shared_folder, write_cut
from auditlake.sources.telemetry import read_stream, write_alerts
from auditlake.streaming import jobs

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events(spark, sf):
    return read_stream(spark, sf, EVENTS, pathGlobFilter="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


#: Rows of a file that a stream reads; a batch has as many files as one slice of time.
FILE_ROWS = 2_000_000


def event_batches(spark, sf, n=3):
    """The events as a stream of n batches, each a slice of time."""
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(F.unix_micros("ts"), [k / n for k in range(1, n)], 10_000), F.count(F.lit(1))).first()
    files = max(1, -(-cuts[1] // FILE_ROWS))
    slices = F.lit(0)
    for cut in cuts[0] or []:
        slices = slices + F.coalesce((F.unix_micros("ts") >= cut).cast("int"), F.lit(0))
    path = folder(spark, "events")
    for k in range(n):  # one after another, since a stream takes files in the order of their times
        rows.where(slices == k).repartition(files).write.mode("append").parquet(path)
    return read_stream(spark, path, EVENTS.replace("TIMESTAMP_NTZ", "TIMESTAMP"), files_per_trigger=files)


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drained(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def to_table(stream, spark, name, mode="append"):
    """Run a streaming query over everything there and read its output table."""
    root = folder(spark, name)

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    drained(jobs.run_batches(stream, save, f"{root}/checkpoint", mode))
    return spark.read.parquet(f"{root}/out")


CHANGES_SQL = f"""WITH {WATCH_SQL} SELECT program_id, event_id, a AS new_authority, p AS previous_authority,
 CASE WHEN rn = 1 THEN 'FirstSeen' WHEN a IS NULL THEN 'Revoked' ELSE 'Transferred' END AS event_type FROM l WHERE rn = 1 OR a IS DISTINCT FROM p"""


def _watched(spark, sf):
    root = folder(spark, "authority")
    stream = event_batches(spark, sf).select(
        F.col("user_id").alias("program_id"), "event_id", "ts", F.nullif(F.col("event_type"), F.lit("error")).alias("authority"))
    drained(jobs.watch_authority(stream, root, order=("ts", "event_id")))
    return spark.read.parquet(f"{root}/output")


@query("stream_authority", CHANGES_SQL)
def stream_authority(spark, sf):
    return _watched(spark, sf).select("program_id", "event_id", "new_authority", "previous_authority", "event_type")


@query("stream_alerts", f"""WITH c AS ({CHANGES_SQL}) SELECT program_id, event_id, 'Authority ' || lower(event_type) AS title, channel, CASE event_type WHEN 'Revoked' THEN 'High' ELSE 'Critical' END AS severity
 FROM c, (VALUES ('chat'), ('mail')) v(channel) WHERE event_type <> 'FirstSeen'""")
def stream_alerts(spark, sf):
    out = jobs.alerts(_watched(spark, sf), ["chat", "mail"])
    return out.select("program_id", "event_id", "title", "channel", "severity")


@query("stream_alert_sink", "SELECT event_id, 'ops' AS channel FROM events WHERE event_type = 'error' AND value > 60")
def stream_alert_sink(spark, sf):
    root = folder(spark, "alerts")
    hot = events(spark, sf).filter("event_type = 'error' and value > 60").select("event_id", F.lit("ops").alias("channel"))
    drained(write_alerts(hot, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out").select("event_id", "channel")


SAMPLE_SQL = "s AS (SELECT user_id % 50 AS validator, date_trunc('hour', ts) AS start, value * 60 AS latency_ms, 1 + user_id % 4 AS num_slots, CAST(floor(value * 200) AS BIGINT) AS num_transactions FROM events)"
MONITOR_SQL = f"""WITH {SAMPLE_SQL}, m AS (SELECT validator, start, count(*) AS n, avg(latency_ms) AS latency_ms, least(greatest((3000.0::DOUBLE - sum(num_transactions) / sum(num_slots)) / 3000.0::DOUBLE * 100, 0), 100) AS skip_rate,
  least(avg(num_transactions / num_slots) / 5000.0::DOUBLE * 100, 100) AS stress FROM s GROUP BY ALL),
 b AS (SELECT *, [CASE WHEN latency_ms > 3000 THEN 'c' WHEN latency_ms > 2000 THEN 'h' WHEN latency_ms > 1000 THEN 'm' END, CASE WHEN skip_rate > 9 THEN 'c' WHEN skip_rate > 6 THEN 'h' WHEN skip_rate > 3 THEN 'm' END, CASE WHEN stress > 90 THEN 'c' WHEN stress > 80 THEN 'h' WHEN stress > 70 THEN 'm' END] AS x FROM m),
 k AS (SELECT *, len(list_filter(x, lambda v: v = 'c')) AS c, len(list_filter(x, lambda v: v = 'h')) AS h, len(list_filter(x, lambda v: v = 'm')) AS d FROM b)
 SELECT validator, start, n, round(latency_ms, 4) AS latency_ms, round(skip_rate, 4) AS skip_rate, round(stress, 4) AS stress,
 CAST(floor(100.0::DOUBLE - least(c * 15.0::DOUBLE / (1 + c * 0.2::DOUBLE), 40) - least(h * 10.0::DOUBLE / (1 + h * 0.3::DOUBLE), 25) - least(d * 5.0::DOUBLE / (1 + d * 0.4::DOUBLE), 15)) AS INTEGER) AS health FROM k"""


def _samples(e):
    return e.select((F.col("user_id") % 50).alias("validator"), "ts", (F.col("value") * 60).alias("latency_ms"),
                    (F.col("user_id") % 4 + 1).alias("num_slots"), F.floor(F.col("value") * 200).alias("num_transactions"))


def _shown(out):
    rounded = {c: F.round(c, 4) for c in ("latency_ms", "skip_rate", "stress")}
    return out.withColumns(rounded).select("validator", F.col("start").cast("timestamp_ntz").alias("start"), "n", "latency_ms", "skip_rate", "stress", "health")


@query("interval_health", MONITOR_SQL)
def interval_health(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _shown(jobs.interval_health(jobs.interval_metrics(_samples(e), ["validator"], "1 hour")))


@query("stream_monitor", MONITOR_SQL)
def stream_monitor(spark, sf):
    """Update mode: the last row of an interval is its final state."""
    stream = jobs.interval_metrics(_samples(events(spark, sf)).withWatermark("ts", "1 hour"), ["validator"], "1 hour")
    rows = to_table(stream, spark, "monitor", "update")
    last = rows.groupBy("validator", "start").agg(F.max_by(F.struct("n", "latency_ms", "skip_rate", "stress"), "batch").alias("_l"))
    return _shown(jobs.interval_health(last.select("validator", "start", "_l.*")))


@query("stream_intervals", MONITOR_SQL + " WHERE start + INTERVAL 2 HOUR <= (SELECT max(date_trunc('milliseconds', ts)) FROM events)")
def stream_intervals(spark, sf):
    """Append mode over several batches: the intervals that the watermark, an hour behind, has passed."""
    return _shown(to_table(jobs.monitor(_samples(event_batches(spark, sf)), ["validator"], "1 hour", "1 hour"), spark, "intervals"))


@query("stream_metrics", "SELECT event_type, count(*) AS count, sum(v)::BIGINT AS sum_ms, (sum(v) // count(v))::BIGINT AS avg_ms, min(v) AS min_ms, max(v) AS max_ms FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY event_type")
def stream_metrics(spark, sf):
    stream = jobs.stream_metrics(events(spark, sf).withColumn("value_ms", F.floor("value")), ["event_type"])
    rows = to_table(stream, spark, "metrics", "update")
    names = ["count", "sum_ms", "avg_ms", "min_ms", "max_ms"]
    return rows.groupBy("event_type").agg(F.max_by(F.struct(*names), "batch").alias("_l")).select("event_type", "_l.*")


@query("stream_dedupe", "SELECT DISTINCT sha256(user_id || ':' || event_type || ':' || props) AS fingerprint FROM events")
def stream_dedupe(spark, sf):
    """A watermark delay longer than the table's month keeps every fingerprint, as the oracle does."""
    out = to_table(jobs.dedupe_stream(events(spark, sf), ["user_id", "event_type", "props"], watermark="60 days"), spark, "dedupe")
    return out.select("fingerprint")


@query("stream_scoreboard", """WITH s AS (SELECT user_id AS program, arg_max(CAST(floor(value) AS BIGINT) % 101, {'a': ts, 'b': CAST(floor(value) AS BIGINT) % 101}) AS score FROM events GROUP BY 1)
 SELECT row_number() OVER (ORDER BY score DESC, program) AS rank, program, score FROM s""")
def stream_scoreboard(spark, sf):
    from auditlake.operators.findings import rank_scoreboard

    root = folder(spark, "scoreboard")
    stream = event_batches(spark, sf).select(F.col("user_id").alias("program"), "ts", (F.floor("value") % 101).alias("score"))
    drained(jobs.upsert_scoreboard(stream, root))
    newest = spark.read.parquet(f"{root}/state").groupBy("program").agg(F.max_by("score", "batch").alias("score"))
    return rank_scoreboard(newest).select("rank", "program", "score")


def _requests(e):
    return e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))


RATE, BURST = 1 / 14400, 2.0


# One token in four hours, bursts of two; microseconds are the unit.
BUCKET_SQL = """WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 f AS (SELECT key, seq, us, rn, true AS admitted, 14400000000 AS units FROM r WHERE rn = 1
  UNION ALL SELECT r.key, r.seq, r.us, r.rn, least(28800000000, f.units + r.us - f.us) >= 14400000000,
   least(28800000000, f.units + r.us - f.us) - CASE WHEN least(28800000000, f.units + r.us - f.us) >= 14400000000 THEN 14400000000 ELSE 0 END
  FROM f JOIN r ON r.key IS NOT DISTINCT FROM f.key AND r.rn = f.rn + 1)
 SELECT key, seq, admitted, round(units / 14400000000, 6) AS tokens FROM f"""


def _admitted(out):
    return out.select("key", "seq", "admitted", F.round("tokens", 6).alias("tokens"))


@query("token_bucket", BUCKET_SQL)
def token_bucket_query(spark, sf):
    """One request per four hours and user, bursts of two."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _admitted(token_bucket(_requests(e), RATE, BURST))


@query("stream_admission", BUCKET_SQL)
def stream_admission(spark, sf):
    """In batches; a bucket that idles as long as it takes to fill is dropped."""
    root = folder(spark, "admission")
    drained(jobs.admit(_requests(event_batches(spark, sf)), root, RATE, BURST, idle_seconds=BURST / RATE))
    return _admitted(spark.read.parquet(f"{root}/output"))


@query("stream_scan")
def stream_scan(spark, sf):
    """Findings of a stream of file versions; equals `raw_findings` of the same files (see tests)."""
    files = write_cut(code_files(spark, sf).select("program", "file_path", "file_name", "content"))
    stream = read_stream(spark, files.inputFiles()[0].rsplit("/", 1)[0], "program string, file_path string, file_name string, content string")
    root = folder(spark, "scan")
    drained(jobs.scan_stream(stream, root))
    out = jobs.current_findings(spark, root)
    return out.groupBy("program", "id").agg(F.count(F.lit(1)).alias("n"))

