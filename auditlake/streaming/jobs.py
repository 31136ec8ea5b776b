"""Continuous versions of the monitors, counters, dedupe, scoreboard, admission and scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import band
from auditlake.functions.text import fingerprint
from auditlake.operators.scores import health_score
from auditlake.plans.scan import raw_findings
from auditlake.session import write_cut
from auditlake.streaming.keyed import AuthorityChanges, Buckets, run_batches, run_to

# Severity of an authority event.
EVENT_SEVERITY = {"Transferred": "Critical", "Upgraded": "Critical", "Revoked": "High", "FirstSeen": "Info"}
SILENT = "FirstSeen"


def event_severity(event_type: Column) -> Column:
    out = F.lit("Info")
    for name, severity in EVENT_SEVERITY.items():
        out = F.when(event_type == name, F.lit(severity)).otherwise(out)
    return out


def authority_stream(stream: DataFrame, key: str = "program_id", authority: str = "authority", order=("detected_at",)) -> DataFrame:
    """Streaming authority changes: each key's last authority is keyed state of the query.

    Rows of a batch are put in order, and rows no newer than the key's last one are ignored. A key's rows of one batch meet in one
    task, so files_per_trigger bounds what it holds. Start it under keyed_state."""
    return AuthorityChanges.over(stream, key, authority, list(order)).withColumn("severity", event_severity(F.col("event_type")))


def watch_authority(stream: DataFrame, root: str, key: str = "program_id", authority: str = "authority", order=("detected_at",), **trigger):
    """Authority changes, written by batch below {root}/output."""
    return run_to(authority_stream(stream, key, authority, order), f"{root}/output", f"{root}/checkpoint", **trigger)


def alerts(events: DataFrame, channels: list[str]) -> DataFrame:
    """One alert per event and channel; first sightings stay silent."""
    title = F.concat(F.lit("Authority "), F.lower("event_type"))
    body = F.to_json(F.struct("previous_authority", "new_authority"))
    return events.filter(F.col("event_type") != SILENT).select(
        "*", title.alias("title"), body.alias("details"), F.explode(F.lit(channels)).alias("channel"))


# Limits of the monitors.
LATENCY_MS, LAG_MS, SKIP = 1000.0, 500.0, 3.0


def interval_metrics(samples: DataFrame, by: list[str], window: str = "1 minute") -> DataFrame:
    """Per key and interval: latency, load and skip rate. Works on a stream with a watermark and in batch."""
    per_slot = F.try_divide(F.sum("num_transactions"), F.sum("num_slots"))
    skip = F.least(F.greatest((F.lit(3000.0) - per_slot) / 3000.0 * 100, F.lit(0.0)), F.lit(100.0))
    load = F.avg(F.try_divide(F.col("num_transactions"), F.col("num_slots")))
    stress = F.when(load.isNotNull(), F.least(load / 5000.0 * 100, F.lit(100.0))).otherwise(F.lit(0.0))
    grouped = samples.groupBy(*by, F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("latency_ms"), skip.alias("skip_rate"), stress.alias("stress"))
    return grouped.select(*by, F.col("w.start").alias("start"), "n", "latency_ms", "skip_rate", "stress")


def interval_health(metrics: DataFrame) -> DataFrame:
    """Bands of an interval's measurements and its health score."""
    bands = [band(F.col("latency_ms"), LATENCY_MS), band(F.col("skip_rate"), SKIP),
             F.when(F.col("stress") > 90, "Critical").when(F.col("stress") > 80, "High").when(F.col("stress") > 70, "Medium")]
    counts = {}
    for name in ("critical", "high", "medium", "low"):
        total = F.lit(0)
        for b in bands:
            total = total + F.coalesce((b == name.capitalize()).cast("int"), F.lit(0))
        counts[name] = total
    return metrics.withColumns(counts).withColumn("health", health_score())


def monitor(stream: DataFrame, by: list[str], window: str = "1 minute", watermark: str = "5 minutes") -> DataFrame:
    """Streaming intervals with bands and health; an interval is emitted once the watermark passes it."""
    return interval_health(interval_metrics(stream.withWatermark("ts", watermark), by, window))


def stream_metrics(stream: DataFrame, by: list[str], value: str = "value_ms") -> DataFrame:
    """Online counters and histograms (update or complete mode)."""
    return stream.groupBy(*by).agg(
        F.count(value).alias("count"), F.sum(value).alias("sum_ms"),
        F.floor(F.sum(value) / F.count(value)).alias("avg_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))


def dedupe_stream(stream: DataFrame, cols: list[str], ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """First finding per fingerprint; fingerprints are forgotten once the watermark has passed them."""
    return stream.withColumn("fingerprint", fingerprint(cols)).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["fingerprint"])


def admission_stream(
    stream: DataFrame, rate: float, burst: float, key: str = "key", ts: str = "ts", seq: str = "seq",
    idle_seconds: float | None = None, late: str = "10 minutes",
) -> DataFrame:
    """Streaming token buckets: requests with `admitted` and `tokens`; each key's bucket is keyed state of the query.

    idle_seconds: a bucket is dropped by an event-time timer once the watermark, `late` behind the newest request, has passed its
    last request by so much; requests that come later than the watermark are then left out, as in any query with one. Start it
    under keyed_state."""
    return Buckets.over(stream, rate, burst, key, ts, seq, idle_seconds, late)


def admit(
    stream: DataFrame, root: str, rate: float, burst: float, key: str = "key", ts: str = "ts", seq: str = "seq",
    idle_seconds: float | None = None, late: str = "10 minutes", **trigger,
):
    """Token-bucket admission, written by batch below {root}/output."""
    return run_to(admission_stream(stream, rate, burst, key, ts, seq, idle_seconds, late), f"{root}/output", f"{root}/checkpoint", **trigger)


def scoreboard_stream(stream: DataFrame, key: str = "program", at: str = "ts", score: str = "score") -> DataFrame:
    """Newest score per program (update mode)."""
    return stream.groupBy(key).agg(F.max_by(F.struct(score, at), F.struct(at, score)).alias("_l")).select(key, "_l.*")


def upsert_scoreboard(stream: DataFrame, root: str, key: str = "program", at: str = "ts", score: str = "score", **trigger):
    """Newest score of the programs that each batch touched, below {root}/state."""
    return run_to(scoreboard_stream(stream, key, at, score), f"{root}/state", f"{root}/checkpoint", "update", **trigger)


def scan_stream(files: DataFrame, root: str, **trigger):
    """Scan each new version of a file; its findings replace the older ones by batch number."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        raw_findings(batch).write.mode("overwrite").parquet(f"{root}/findings/batch={batch_id}")
        batch.select("file_path").distinct().write.mode("overwrite").parquet(f"{root}/files/batch={batch_id}")

    return run_batches(files, handle, f"{root}/checkpoint", **trigger)


def current_findings(spark, root: str) -> DataFrame:
    """Findings of the latest scan of each file. Scans that a later one replaced are found among the files and written, so that all
    findings only meet those few."""
    scans = spark.read.parquet(f"{root}/files")
    again = scans.groupBy("file_path").agg(F.max("batch").alias("_last"), F.min("batch").alias("_first")).where("_first < _last")
    replaced = write_cut(scans.join(again, "file_path").where("batch < _last").select("file_path", "batch"))
    found = spark.read.parquet(f"{root}/findings").where("file_path is not null")
    done = found.join(F.broadcast(scans.select("batch").distinct()), "batch", "left_semi")
    return done.join(replaced, ["file_path", "batch"], "left_anti").drop("batch")
