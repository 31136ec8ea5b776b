"""Packing: length buckets chosen by dynamic programming over the global histogram, then token-budget batches inside buckets.

A batch is padded to its bucket's bound, so the cost of a choice of bounds is the sum of (bound - length). The histogram holds every
length as it is. Different lengths number at most the square root of twice all tokens, and a round of the programme takes time in
proportion to them (lower hull of lines), in whole numbers on the driver, so the bounds are the exact optimum.
"""

from __future__ import annotations

from collections import deque
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import n_words, table, write_cut

#: Number of length buckets, padded tokens of a batch, and documents that one task puts in order.
BUCKETS, BUDGET, SHARD_ROWS = 16, 65_536, 50_000


def tokens(text: Column) -> Column:
    """Length of a document: its words and one end mark, so that none is empty."""
    return n_words(text) + 1


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Bounds (ascending, the last is the longest length) that minimise padding with at most so many buckets."""
    if not lengths:
        return []
    at, n, size = [int(x) for x in lengths], [0, *accumulate(int(x) for x in counts)], len(lengths)
    # cost of the first j lengths with k buckets; the padding of lengths i..j-1 is at[j-1] * (n[j] - n[i]) less their own sum,
    # and those sums add up to the same whatever the choice
    best = [0, *(x * m for x, m in zip(at, n[1:], strict=True))]
    cuts = []
    for _ in range(1, min(buckets, size)):
        new, cut, hull = [0] * (size + 1), [0] * (size + 1), deque()
        for j in range(1, size + 1):
            # the cut i is the line best[i] - n[i] * x; slopes fall with i and x = at[j-1] grows, so the least line only moves on
            i, x = j - 1, at[j - 1]
            while len(hull) > 1 and (best[i] - best[hull[-2]]) * (n[hull[-1]] - n[hull[-2]]) <= (best[hull[-1]] - best[hull[-2]]) * (n[i] - n[hull[-2]]):
                hull.pop()
            hull.append(i)
            while len(hull) > 1 and best[hull[1]] - n[hull[1]] * x <= best[hull[0]] - n[hull[0]] * x:
                hull.popleft()
            cut[j] = hull[0]
            new[j] = best[hull[0]] + x * (n[j] - n[hull[0]])
        cuts.append(cut)
        best = new
    bounds, j = [], size
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = cut[j]
    if j > 0:
        bounds.append(lengths[j - 1])
    return sorted(bounds)


def bucket_bounds(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Best bounds for all lengths of column tokens."""
    histogram = lengths.groupBy(F.col("tokens").alias("length")).count().collect()
    pairs = sorted((r["length"], r["count"]) for r in histogram)
    return best_bounds([a for a, _ in pairs], [b for _, b in pairs], buckets)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) with a struct column __pack: n_tokens, bucket (its bound), batch_id and slot.

    A batch of bound b has max(1, budget // b) slots; documents of a bucket fill batches in the order of a hash of their id, so
    only the last batch of a bucket can be short. Numbering is by shards of a bucket: each shard is ordered alone and starts at
    the summed sizes of the shards before it, so neither a bucket nor a hot length meets in one task. Null and empty texts have
    one token; null ids and repeated rows are packed like others, rows of equal id and length (or of no id and equal text) in any
    order; a text longer than the budget is a batch alone; an empty table gives no batch. Other columns, whatever their names, pass
    through; one named __pack is replaced."""
    docs = docs.drop("__pack")
    # rows without an id are ordered by their texts
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("string")))
    length = tokens(F.col("text"))
    measured = write_cut(docs.select(length.alias("tokens"), own.alias("own")))
    bounds = bucket_bounds(measured, buckets)
    total = measured.count()
    shards = max(1, -(-total // shard_rows))

    def placed(rows: DataFrame) -> DataFrame:
        steps = [F.when(F.col("tokens") <= b, F.lit(b).cast("long")) for b in bounds or [1]]
        rows = rows.withColumns({"bound": F.least(*steps, F.lit(bounds[-1] if bounds else 1).cast("long")), "order": F.xxhash64("own", "tokens")})
        return rows.withColumn("shard", F.pmod(F.shiftright("order", 24), F.lit(shards)).cast("int"))

    sizes = placed(measured).groupBy("bound", "shard").count()
    before = Window.partitionBy("bound").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("bound").alias("b"), F.col("shard").alias("s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("bound", "shard").orderBy("order", F.col("doc.doc_id").asc_nulls_last()))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), length.alias("tokens"), own.alias("own"))
    numbered = placed(rows).withColumn("n", number).join(starts, (F.col("bound") == F.col("b")) & (F.col("shard") == F.col("s")))
    slots = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bound")))
    nth = F.col("start") + F.col("n") - 1
    packed = F.struct(F.col("tokens").alias("n_tokens"), F.col("bound").alias("bucket"), F.concat_ws("-", F.col("bound"), F.floor(nth / slots)).alias("batch_id"), (nth % slots).cast("int").alias("slot"))
    return numbered.select("doc.*", packed.alias("__pack"))


def packs(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_tokens, bucket, batch_id, slot, padding)."""
    packed = pack(docs.select("doc_id", "text"), **options).select("doc_id", "__pack.*")
    return packed.withColumn("padding", F.col("bucket") - F.col("n_tokens"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packs(table(spark, folder, "documents"))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
