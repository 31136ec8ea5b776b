"""Keyed state of streams, kept by Spark's state store: last authority of a key and its token bucket."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StringType, StructType, TimestampNTZType, TimestampType

from auditlake.operators.admission import FULL, Limits

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the state store that keyed state needs; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_batches(stream: DataFrame, handle, checkpoint: str, mode: str = "append", **trigger):
    """Start a foreachBatch query; by default it takes what is there and stops."""
    with keyed_state(stream.sparkSession):
        return (
            stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger):
    """Write every batch to a folder of its own, {path}/batch=N; a batch that is run again overwrites only itself."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_batches(stream, save, checkpoint, mode, **trigger)


def _in_order(value) -> tuple:
    """Orders a tuple as Spark does: nulls first."""
    return tuple((x is not None, x) for x in value)


class AuthorityChanges(StatefulProcessor):
    """Rows where a key's authority is first seen, revoked or transferred."""

    def __init__(self, state: str, authority: str, order: list[str], fields: list[str]):
        self.state, self.authority, self.order, self.fields = state, authority, order, fields

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        place = lambda row: _in_order(row[c] for c in self.order)
        old = self.last.get() if self.last.exists() else None
        newest = None if old is None else _in_order(old[1:])
        known, had = (None, False) if old is None else (old[0], True)
        last = None
        for row in sorted(rows, key=place):
            if newest is not None and place(row) <= newest:
                continue
            now = row[self.authority]
            kind = "FirstSeen" if not had else None if now == known else "Revoked" if now is None else "Transferred"
            if kind:
                made = {c: row[c] for c in self.order} | {"_key": key[0], "new_authority": now, "event_type": kind, "previous_authority": known}
                yield Row(**{c: made[c] for c in self.fields})
            known, had, last = now, True, row
        if last is not None:
            self.last.update((last[self.authority], *(last[c] for c in self.order)))

    def close(self) -> None:
        pass

    @staticmethod
    def over(stream: DataFrame, key: str, authority: str, order: list[str]) -> DataFrame:
        # times pass as microseconds, which no time zone changes
        times = [c for c in order if isinstance(stream.schema[c].dataType, (TimestampType, TimestampNTZType))]
        plain = {c: F.unix_micros(F.col(c).cast("timestamp")) for c in times}
        rows = stream.select(F.col(key).alias("_key"), F.col(authority).alias("_authority"), *order).withColumns(plain)
        kinds = {f.name: f.dataType for f in rows.schema}
        out = StructType().add("_key", kinds["_key"])
        state = StructType().add("_authority", kinds["_authority"])
        for c in order:
            out, state = out.add(c, kinds[c]), state.add(c, kinds[c])
        out = out.add("new_authority", kinds["_authority"]).add("event_type", StringType()).add("previous_authority", kinds["_authority"])
        changes = rows.groupBy("_key").transformWithState(
            statefulProcessor=AuthorityChanges(state, "_authority", order, out.fieldNames()), outputStructType=out, outputMode="append", timeMode="none"
        )
        back = {c: F.timestamp_micros(c).cast(stream.schema[c].dataType) for c in times}
        return changes.withColumns(back).withColumnRenamed("_key", key) if back else changes.withColumnRenamed("_key", key)


class Buckets(StatefulProcessor):
    """Token bucket of a key; with idle, a timer drops it so many milliseconds after its last request."""

    def __init__(self, limits: Limits, idle: int | None, fields: list[str]):
        self.limits, self.idle, self.fields = limits, idle, fields

    def init(self, handle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "units long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        v, at = FULL, None
        if self.bucket.exists():
            units, at = self.bucket.get()
            v = at * self.limits.scale - units
            # timers of this batch run after its rows
            if self.idle is not None and at // 1000 + self.idle <= timerValues.getCurrentWatermarkInMs():
                v = FULL
        for row in sorted(rows, key=lambda r: _in_order((r["_us"], r["_seq"]))):
            ok, left = False, None
            if row["_us"] is not None:
                t = row["_us"] * self.limits.scale
                ok, v = self.limits.after(v, t)
                at, left = row["_us"], self.limits.tokens(v, t)
            made = {"row": row["row"], "admitted": ok, "tokens": left}
            yield Row(**{c: made[c] for c in self.fields})
        if at is not None:
            self.bucket.update((at * self.limits.scale - v, at))
            if self.idle is not None:
                self.handle.registerTimer(at // 1000 + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a later request has a timer of its own
        if self.bucket.exists() and self.bucket.get()[1] // 1000 + self.idle <= expiredTimerInfo.getExpiryTimeInMs():
            self.bucket.clear()
        return iter(())

    def close(self) -> None:
        pass

    @staticmethod
    def over(stream: DataFrame, rate: float, burst: float, key: str, ts: str, seq: str, idle_seconds: float | None, late: str) -> DataFrame:
        rows = stream.select(
            F.col(key).alias("_key"), F.col(ts).cast("timestamp").alias("_ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"),
            F.col(seq).alias("_seq"), F.struct(*stream.columns).alias("row"),
        )
        if idle_seconds is not None:
            rows = rows.withWatermark("_ts", late)
        out = StructType().add("row", rows.schema["row"].dataType).add("admitted", "boolean").add("tokens", "double")
        made = rows.groupBy("_key").transformWithState(
            statefulProcessor=Buckets(Limits.of(rate, burst), None if idle_seconds is None else int(idle_seconds * 1000), out.fieldNames()),
            outputStructType=out, outputMode="append", timeMode="none" if idle_seconds is None else "eventTime",
        )
        return made.select("row.*", "admitted", "tokens")
