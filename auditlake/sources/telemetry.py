"""Streams of telemetry and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None, **options) -> DataFrame:
    """Files that arrive in a folder, or a Kafka topic (fmt='kafka', options as Spark names them)."""
    reader = spark.readStream.format(fmt).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "kafka":
        raw = reader.load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")
    return reader.schema(schema).load(path)


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, **trigger):
    """Append alerts by batch id: a batch that is run again overwrites its own folder only."""
    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return alerts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
