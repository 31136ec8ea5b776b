"""Token-bucket admission per key, in batch form.

A bucket refills `rate` tokens a second up to `burst`; a request that finds a whole token spends it. All sums are whole numbers: with v
the time at which the bucket would have been empty, a request at t sets v to max(v, t - burst) and is admitted, one token later, if a
whole token fits between v and t.

Rows are range-partitioned by key and time, so a busy key spans many tasks. A task knows the buckets of all its keys but the first,
which may go on from the task before. For that key it keeps the function from v at the task's start to v now: a step function whose
pieces grow with the burst and the requests in a token's time, not with the rows, and that is constant as soon as an idle gap fills
the bucket. The functions of all tasks (one row each) are composed in order, and the rows that waited are then settled where they are.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructType

from auditlake.session import write_cut

#: Before all times: a bucket that starts here is full.
FULL = -(1 << 200)
#: One step function: (from, slope 0 or 1, constant) for each piece, ascending.
Steps = list[tuple[int, int, int]]
UNCHANGED: Steps = [(FULL, 1, 0)]


@dataclass(frozen=True)
class Limits:
    """Whole-number form of rate and burst: time units of a microsecond, of a token and of a full bucket."""

    scale: int
    token: int
    burst: int

    @staticmethod
    def of(rate: float, burst: float) -> Limits:
        exact = Fraction(rate).limit_denominator(10**6)
        if exact <= 0:
            raise ValueError("rate must be at least one token in a million seconds")
        token = exact.denominator * 10**6
        return Limits(exact.numerator, token, int(Fraction(burst).limit_denominator(10**6) * token))

    def after(self, v: int, t: int) -> tuple[bool, int]:
        """(admitted, v after a request at t), t in time units."""
        v = max(v, t - self.burst)
        return (True, v + self.token) if t - v >= self.token else (False, v)

    def tokens(self, v: int, t: int) -> float:
        return (t - v) / self.token

    def advance(self, steps: Steps, t: int, top: int) -> Steps:
        """The function of one more request at t, for arguments up to top, the time of the first request."""
        least, last = t - self.burst, t - self.token
        out: Steps = []

        def add(low: int, slope: int, constant: int) -> None:
            if low <= top and (not out or out[-1][1:] != (slope, constant)):
                out.append((low, slope, constant))

        def admit(low: int, high: int | None, slope: int, constant: int) -> None:
            if not slope:
                add(low, 0, constant + self.token if constant <= last else constant)
                return
            edge = last - constant + 1
            if low < edge:
                add(low, 1, constant + self.token)
            if high is None or edge < high:
                add(max(low, edge), 1, constant)

        for k, (low, slope, constant) in enumerate(steps):
            high = steps[k + 1][0] if k + 1 < len(steps) else None
            if not slope:
                admit(low, high, 0, max(constant, least))
                continue
            edge = least - constant
            if low < edge:
                admit(low, edge if high is None else min(edge, high), 0, least)
            if high is None or edge < high:
                admit(max(low, edge), high, 1, constant)
        return out


def value(steps: Steps, v: int) -> int:
    """A step function at v."""
    _, slope, constant = steps[max(0, bisect_right(steps, v, key=lambda piece: piece[0]) - 1)]
    return v + constant if slope else constant


def _settle(limits: Limits, v: int, times: list[int | None]) -> tuple[int, list[bool], list[float | None]]:
    """(v after all, admitted, tokens left) of one key's requests; one without a time is refused and changes nothing."""
    admitted, left = [], []
    for t in times:
        if t is None:
            admitted.append(False)
            left.append(None)
            continue
        ok, v = limits.after(v, t)
        admitted.append(ok)
        left.append(limits.tokens(v, t))
    return v, admitted, left


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def token_bucket(requests: DataFrame, rate: float, burst: float, key: str = "key", ts: str = "ts", seq: str = "seq", state: DataFrame | None = None) -> DataFrame:
    """requests with `admitted` and `tokens` (left after the request).

    ts is a TIMESTAMP, seq breaks ties. state: key, tokens, last_ts from an earlier run, one row for a key; keys without state
    start full. rate and burst are taken as fractions with denominators of at most a million. Null keys are one key; a request
    without a time is refused, has null tokens and changes nothing; rows of equal key, time and seq go in any order."""
    limits = Limits.of(rate, burst)
    spark = requests.sparkSession
    rows = requests.select(F.struct(*(F.col(f"`{c}`") for c in requests.columns)).alias("row"), F.col(key).alias("key"), F.unix_micros(ts).alias("us"), F.col(seq).alias("seq"))
    old = [F.lit(None).cast("long").alias("u0"), F.lit(None).cast("long").alias("x0")]
    if state is not None:
        known = state.select(F.col(key).alias("k0"), F.unix_micros("last_ts").alias("u0"), F.round(F.col("tokens") * limits.token).cast("long").alias("x0"))
        rows, old = rows.join(known, F.col("key").eqNullSafe(F.col("k0")), "left"), ["u0", "x0"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "us", "seq"]
    placed = rows.select("row", *order, *old).repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("seq")
    key_type, row_type = placed.schema["key"].dataType, placed.schema["row"].dataType
    edge_type = StructType().add("first", key_type).add("last", key_type).add("u0", LongType()).add("x0", LongType()).add("after", BinaryType())
    out = StructType().add("part", IntegerType()).add("rows", ArrayType(row_type)).add("times", ArrayType(LongType())).add("before", BinaryType())
    out = out.add("admitted", ArrayType(BooleanType())).add("tokens", ArrayType(DoubleType())).add("edge", edge_type)

    def start(u0, x0) -> int:
        return FULL if u0 is None else u0 * limits.scale - x0

    def fold(batches):
        part, steps, top, v, last, edge, arrow = TaskContext.get().partitionId(), list(UNCHANGED), None, None, None, None, None

        def record(part_rows, times, before, admitted, left, ends):
            one = lambda x, kind: pa.array([x], kind)
            held = pa.ListArray.from_arrays(pa.array([0, len(part_rows)], pa.int32()), part_rows)
            edges = pa.StructArray.from_arrays([ends[0], ends[1], one(ends[2], pa.int64()), one(ends[3], pa.int64()), one(ends[4], pa.binary())], ["first", "last", "u0", "x0", "after"], mask=pa.array([ends[4] is None]))
            columns = [one(part, pa.int32()), held, one(times, pa.list_(pa.int64())), one(before, pa.binary()), one(admitted, pa.list_(pa.bool_())), one(left, pa.list_(pa.float64())), edges]
            return pa.RecordBatch.from_arrays(columns, out.fieldNames())

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, u0, x0 = batch.column(1), batch.column(3), batch.column(4)
            codes = pc.dictionary_encode(keys, null_encoding="encode").indices.to_pylist()
            micros = batch.column(2).to_pylist()
            times = [None if us is None else us * limits.scale for us in micros]
            nothing = (keys.slice(0, 1), keys.slice(0, 1), None, None, None)
            arrow = batch.column(0).slice(0, 0)
            if edge is None:
                edge = [keys.slice(0, 1), None, u0[0].as_py(), x0[0].as_py()]
                new = False
            else:
                new = not _same(last.as_py(), keys[0].as_py())
            admitted, left, waits, before, at = [], [], 0, None, 0
            while at < len(codes):
                to = at + 1
                while to < len(codes) and codes[to] == codes[at]:
                    to += 1
                if new:
                    v = start(u0[at].as_py(), x0[at].as_py())
                if v is None:
                    before = pickle.dumps(steps)
                    while at < to and v is None:
                        if times[at] is not None:
                            top = times[at] if top is None else top
                            steps = limits.advance(steps, times[at], top)
                            if len(steps) == 1 and not steps[0][1]:
                                v = steps[0][2]
                        at += 1
                    waits = at
                v, ok, tokens = (v, [], []) if v is None else _settle(limits, v, times[at:to])
                admitted += ok
                left += tokens
                at, new = to, True
            last, new = keys[len(codes) - 1], False
            edge[1] = keys.slice(len(codes) - 1, 1)
            if waits:
                yield record(batch.column(0).slice(0, waits), micros[:waits], before, None, None, nothing)
            if waits < len(codes):
                yield record(batch.column(0).slice(waits), None, None, admitted, left, nothing)
        if edge is not None:
            after = steps if v is None else [(FULL, 0, v)]
            yield record(arrow, None, None, [], [], (edge[0], edge[1], edge[2], edge[3], pickle.dumps(after)))

    parts = write_cut(placed.mapInArrow(fold, out))
    starts, before, v = {}, None, FULL
    for row in parts.where("edge IS NOT NULL").select("part", "edge").orderBy("part").collect():  # one row for a task
        edge = row["edge"]
        follows = before is not None and _same(before["last"], edge["first"])
        starts[row["part"]] = v if follows else start(edge["u0"], edge["x0"])
        v, before = value(pickle.loads(edge["after"]), starts[row["part"]]), edge
    sent = spark.sparkContext.broadcast(starts)

    def settle(batches):
        for batch in batches:
            admitted, left = [], []
            for part, micros, steps in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                times = [None if us is None else us * limits.scale for us in micros]
                _, ok, tokens = _settle(limits, value(pickle.loads(steps), sent.value[part]), times)
                admitted.append(ok)
                left.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(admitted, pa.list_(pa.bool_())), pa.array(left, pa.list_(pa.float64()))], ["rows", "admitted", "tokens"])

    done = StructType().add("rows", ArrayType(row_type)).add("admitted", ArrayType(BooleanType())).add("tokens", ArrayType(DoubleType()))
    waited = parts.where("before IS NOT NULL").select("part", "rows", "times", "before").mapInArrow(settle, done)
    settled = parts.where("admitted IS NOT NULL").select("rows", "admitted", "tokens").unionByName(waited)
    return settled.select(F.explode(F.arrays_zip("rows", "admitted", "tokens")).alias("z")).select("z.rows.*", "z.admitted", "z.tokens")


def bucket_state(admissions: DataFrame, key: str = "key", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Tokens and time of each key's last request: the state of the next run."""
    last = F.max_by(F.struct("tokens", F.col(ts).alias("last_ts")), F.struct(ts, seq))
    return admissions.where(F.col(ts).isNotNull()).groupBy(key).agg(last.alias("_l")).select(key, "_l.tokens", "_l.last_ts")


def evict_stale(state: DataFrame, horizon_seconds: float, now: Column) -> DataFrame:
    """Drop buckets idle for longer than the horizon; their keys start full again."""
    return state.filter(F.unix_micros(now) - F.unix_micros("last_ts") <= F.lit(horizon_seconds * 1e6))
