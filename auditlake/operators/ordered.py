"""Ordered windows that survive a hot key.

A window over (key) puts one key into one task. Here the key's rows are first cut by a bucket that
follows the order (a day, a slot range, ...); each bucket is its own window, and what must cross a
bucket's edge travels in a summary with one row per (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import write_cut


def _names(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _carry(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the keys and the bucket in which nulls are equal."""
    keys = [*keys, "_b"]
    named = summary.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in summary.columns if c not in keys))
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(named, match, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def with_previous(df: DataFrame, keys, order, cols, bucket: Column | None = None, name: str = "prev") -> DataFrame:
    """Add `name`: struct of the previous row's cols within the key, null for the first row."""
    keys, order, cols = _names(keys), _names(order), _names(cols)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.lag(F.struct(*cols)).over(w))
    df = df.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    inner = df.withColumn("_p", F.lag(F.struct(*cols)).over(w)).withColumn("_n", F.row_number().over(w))
    last = df.groupBy(*keys, "_b").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    carry = last.select(
        *keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carry")
    )
    joined = _carry(inner, carry, keys)
    picked = F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_p"))
    return joined.withColumn(name, picked).drop("_b", "_p", "_n", "_carry")


def fill_forward(df: DataFrame, keys, order, col: str, bucket: Column | None = None, name: str = "filled") -> DataFrame:
    """Add `name`: the latest non-null `col` at or before the row, within the key."""
    keys, order = _names(keys), _names(order)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(col, ignorenulls=True).over(w))
    df = df.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumn("_f", F.last(col, ignorenulls=True).over(w))
    last = df.groupBy(*keys, "_b").agg(
        F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.struct(*order))).alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    return (
        _carry(inner, carry, keys)
        .withColumn(name, F.coalesce("_f", "_carry"))
        .drop("_b", "_f", "_carry")
    )


def running_total(df: DataFrame, keys, order, value: Column, bucket: Column, name: str = "total") -> DataFrame:
    """Add `name`: sum of value over the key's rows up to and including this one."""
    keys, order = _names(keys), _names(order)
    df = df.withColumn("_b", bucket).withColumn("_v", value)
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumn("_s", F.sum("_v").over(w))
    sums = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_b", F.sum("_sum").over(before).alias("_carry"))
    return (
        _carry(inner, carry, keys)
        .withColumn(name, F.col("_s") + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop("_b", "_v", "_s", "_carry")
    )


def global_rank(df: DataFrame, order, name: str = "rank") -> DataFrame:
    """Add `name`: 1..n over the whole table, without one task seeing every row.

    The table is range-partitioned by a global sort (balanced by sampling, whatever the skew) and
    written once with its place inside the partition; the counts of the partitions before it, one row
    per task, give the offset.
    """
    placed = write_cut(df.orderBy(*_names(order)).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_id") - F.shiftleft(part, 33)
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row per task
    return joined.withColumn(name, F.col("_off") + local + 1).drop("_part", "_id", "_off")


def nearest_marks(
    df: DataFrame, keys, pos: str, is_mark: Column, width: int, prev: str = "prev_mark", nxt: str = "next_mark"
) -> DataFrame:
    """Add the nearest marked position at or before and strictly after each row, if within width.

    Positions are whole numbers. A bucket is `width` wide, so only the neighbouring bucket's
    last or first mark can matter beyond the row's own bucket.
    """
    keys = _names(keys)
    df = df.withColumn("_m", F.when(is_mark, F.col(pos))).withColumn("_b", F.floor(F.col(pos) / width))
    part = Window.partitionBy(*keys, "_b").orderBy(pos)
    inner = df.withColumn("_p", F.max("_m").over(part.rangeBetween(Window.unboundedPreceding, 0)))
    inner = inner.withColumn("_q", F.min("_m").over(part.rangeBetween(1, Window.unboundedFollowing)))
    edge = df.groupBy(*keys, "_b").agg(F.max("_m").alias("_hi"), F.min("_m").alias("_lo"))
    below = edge.select(*keys, (F.col("_b") + 1).alias("_b"), F.col("_hi"))
    above = edge.select(*keys, (F.col("_b") - 1).alias("_b"), F.col("_lo"))
    out = _carry(_carry(inner, below, keys), above, keys)
    out = out.withColumn(prev, F.coalesce("_p", "_hi")).withColumn(nxt, F.coalesce("_q", "_lo"))
    out = out.withColumn(prev, F.when(F.col(pos) - F.col(prev) <= width, F.col(prev)))
    out = out.withColumn(nxt, F.when(F.col(nxt) - F.col(pos) <= width, F.col(nxt)))
    return out.drop("_m", "_b", "_p", "_q", "_hi", "_lo")
