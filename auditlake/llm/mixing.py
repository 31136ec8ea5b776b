"""Mixing sources to target weights: nested hash thresholds found from token histograms, without sorting documents.

Every document has a fixed 128-bit hash of its id. A source whose target is r times its size takes all of its documents
floor(r) times and those below a threshold once more. The threshold comes from a histogram of words by source and hash prefix;
only the one bucket in which the remaining budget ends is counted again by a longer prefix, until single hashes are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import lookup, n_words, table, write_cut

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of a document.
MOST = 3
#: Hash prefix lengths in hex digits: 4096 buckets a source at each level.
LEVELS = (3, 6, 9)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size). Targets are min(most * size, weight * level) with the level at which
    they add up to all sizes; this is where resharing the excess by weight ends. The ordered windows see one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long"))
    # sources in the order in which the rising level reaches their ceilings
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    below, above = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * most
    stepped = (
        weighed.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("left", F.col("all_size") - F.coalesce(F.sum(cap).over(below), F.lit(0)))
        .withColumn("open", F.sum("weight").over(above))
        # full while the level that would share out what is left still passes the ceiling
        .withColumn("full", cap * F.col("open") <= F.col("left") * F.col("weight"))
    )
    ends = F.struct(F.col("open"), F.col("left"))
    shared = stepped.withColumn("end", F.max(F.when(~F.col("full"), ends)).over(everything))
    target = F.when(F.col("full"), cap.cast("double")).otherwise(
        (F.col("weight") * F.col("end.left")).cast("double") / F.col("end.open").cast("double")
    )
    return shared.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, last): a document is taken whole times, and once more if its hash is at most last.
    sized: (source, size, hash), read once for each level; below the first level only boundary buckets count."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    bounds = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    bounds = bounds.withColumns({"prefix": F.lit(""), "before": F.lit(0).cast("long"), "last": F.lit("")})
    for digits in (*LEVELS, 32):
        edges = bounds.select("source", "budget", "prefix", "before")
        inside = lookup(sized, edges, ["source"]).where((F.col("size") > 0) & F.col("hash").startswith(F.col("prefix")))
        bucket = F.substring("hash", 1, digits)
        counted = inside.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.max("hash").alias("top"), F.first("budget").alias("budget"), F.first("before").alias("before")
        )
        order = Window.partitionBy("source").orderBy("bucket")
        summed = counted.withColumn("start", F.col("before") + F.sum("words").over(order) - F.col("words"))
        # a hash group goes in if more than half of it fits the budget; of a bucket that is not the boundary all goes in or none
        fits = F.col("start") + (F.col("words") / 2 if digits == 32 else F.col("words")) < F.col("budget")
        marked = summed.withColumn("fits", fits)
        found = marked.groupBy("source").agg(
            F.max(F.when(F.col("fits"), F.col("top"))).alias("reached"),
            F.min(F.when(~F.col("fits"), F.struct("bucket", "start"))).alias("edge"),
        )
        bounds = lookup(bounds, found, ["source"]).select(
            "source", "source_size", "target", "whole", "budget",
            F.coalesce("edge.bucket", F.lit("-")).alias("prefix"),
            F.coalesce("edge.start", "before").alias("before"),
            F.coalesce("reached", "last").alias("last"),
        )
        bounds = write_cut(bounds)
    return bounds.select("source", "source_size", "target", "whole", "last")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, size: Column | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) with a struct column __mix: size, source_size, target, copies and taken (words, repeats
    counted). Defined for odd rows: a null or empty text has size 0 and copies of its source's whole part or as its hash falls;
    rows of one source with equal ids (null ids too) are taken alike; a source without words has target 0; no row is dropped.
    Other columns, whatever their names, pass through; one named __mix is replaced."""
    size = n_words(F.col("text")) if size is None else size
    key = F.md5(F.concat(F.lit("mix "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = write_cut(docs.select("source", size.alias("size"), key.alias("hash")))
    bounds = thresholds(sized, source_targets(sized, weights, most))
    found = bounds.select("source", F.struct("source_size", "target", "whole", "last").alias("bound"))
    docs = docs.drop("__mix")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "source", size.alias("size"), key.alias("hash"))
    copies = F.least((F.col("bound.whole") + (F.col("hash") <= F.col("bound.last")).cast("int")).cast("int"), F.lit(most))
    mixed = F.struct("size", F.col("bound.source_size").alias("source_size"), F.col("bound.target").alias("target"), copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))
    return lookup(rows, found, ["source"]).select("doc.*", mixed.alias("__mix"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    taken = mix(docs, weights, most).where("__mix.copies > 0")
    rows = taken.select(F.struct(*(F.col(f"`{c}`") for c in taken.columns if c != "__mix")).alias("doc"), F.explode(F.sequence(F.lit(1), F.col("__mix.copies"))))
    return rows.select("doc.*")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents").select("doc_id", "text", "source")).select("doc_id", "__mix.size", "__mix.source_size", "__mix.target", "__mix.taken")


#: Plain form: sources are filled in rising order of size by weight, documents are sorted by hash and summed.
OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('mix ' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals),
tried AS (
  SELECT a.source_size / a.weight AS level, sum(least(3 * b.source_size, 3 * a.source_size * b.weight / a.weight)) AS used
  FROM weighed a, weighed b GROUP BY a.source, a.source_size, a.weight),
closed AS (SELECT coalesce(max(level), -1) AS level FROM tried WHERE used <= (SELECT sum(source_size) FROM totals)),
rest AS (
  SELECT (SELECT sum(source_size) FROM totals) - coalesce(sum(3 * source_size) FILTER (source_size / weight <= level), 0) AS words,
         sum(weight) FILTER (source_size / weight > level) AS weights
  FROM weighed, closed),
targets AS (
  SELECT source, source_size,
         CASE WHEN source_size / weight <= level THEN (3 * source_size)::DOUBLE ELSE (weight * words)::DOUBLE / weights::DOUBLE END AS target
  FROM weighed, closed, rest),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INT AS whole FROM targets),
grouped AS (
  SELECT source, h, sum(size) AS words FROM sized WHERE size > 0 GROUP BY source, h),
placed AS (
  SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) - words AS start FROM grouped),
chosen AS (
  SELECT p.source, p.h, p.start + p.words / 2 < s.target - s.whole * s.source_size AS more
  FROM placed p JOIN split s ON p.source IS NOT DISTINCT FROM s.source)
SELECT d.doc_id, d.size, s.source_size, s.target, (d.size * least(3, s.whole + coalesce(c.more, false)::INT))::BIGINT AS taken
FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source
LEFT JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": OP1_SQL}
