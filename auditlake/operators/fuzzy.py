"""Fuzzy name matching against a list of legitimate names.

Semantics: the list is read in order. The first entry that equals the name (case-insensitive) or its
'-'/'_' swap or its form without '@' decides: equal means no warning, a structural match scores 0.95.
Otherwise the best normalised edit similarity above the threshold wins, earliest entry on ties.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import normalized_levenshtein

STRUCTURAL = 0.95
THRESHOLD = 0.75


def typosquats(names: DataFrame, legit, name: str = "name", threshold: float = THRESHOLD) -> DataFrame:
    """(name, likely_target, similarity) for each suspicious distinct name.

    legit: list of names in order, or a DataFrame (pos, legit).
    """
    distinct = names.select(F.col(name).alias("name")).distinct()
    if isinstance(legit, (list, tuple)):
        legit = names.sparkSession.createDataFrame(list(enumerate(legit)), "pos long, legit string")
    return _blocked(distinct, legit, threshold)


def _variants(lower: Column) -> list[Column]:
    return [F.replace(lower, F.lit("-"), F.lit("_")), F.replace(lower, F.lit("_"), F.lit("-")),
            F.replace(lower, F.lit("@"), F.lit(""))]


def _pieces(col: Column, max_edits: Column) -> Column:
    """Cut a string into max_edits + 1 pieces: (offset, piece). An edit can spoil one piece only."""
    parts = max_edits + 1
    base, extra = F.floor(F.length(col) / parts), F.length(col) % parts
    return F.transform(
        F.sequence(F.lit(0), (parts - 1).cast("int")),
        lambda i: F.struct(
            (i * base + F.least(i, extra)).cast("int").alias("off"),
            F.substr(col, (i * base + F.least(i, extra) + 1).cast("int"),
                     (base + F.when(i < extra, 1).otherwise(0)).cast("int")).alias("piece"),
        ),
    )


def _blocked(distinct: DataFrame, legit: DataFrame, threshold: float) -> DataFrame:
    """Best match of each name by equi-joins only.

    sim > t means edits < (1-t)*longest, and longest < len(legit)/t, so at most
    k = ceil((1-t)/t*len) - 1 edits. One of k+1 pieces of the legitimate name then occurs unchanged
    in the candidate, shifted by at most k: candidates join on (piece, shared length).
    """
    lists = legit.select("pos", "legit", F.lower("legit").alias("l"))
    n = distinct.withColumn("n", F.lower("name"))
    exact = n.join(lists, n.n == lists.l).groupBy("name").agg(F.min("pos").alias("_eq"))
    variants = n.select("name", F.explode(F.array_distinct(F.array(*_variants(F.col("n"))))).alias("v"))
    structural = (
        variants.join(lists, variants.v == lists.l).groupBy("name")
        .agg(F.min_by("legit", "pos").alias("_target"), F.min("pos").alias("_st"))
    )
    found = n.join(exact, "name", "left").join(structural, "name", "left")
    swapped = found.filter("_st is not null and (_eq is null or _st < _eq)").select(
        "name", F.col("_target").alias("likely_target"), F.lit(STRUCTURAL).alias("similarity")
    )
    rest = found.filter("_eq is null and _st is null").select("name", "n")
    edits = F.greatest(F.ceil(F.length("l") * ((1 - threshold) / threshold)) - 1, F.lit(0)).cast("int")
    pieces = lists.withColumn("k", edits).withColumn("_p", F.explode(_pieces(F.col("l"), F.col("k"))))
    pieces = pieces.select("pos", "legit", "l", "k", "_p.off", "_p.piece", F.length("_p.piece").alias("len"))
    longest = math.ceil(threshold / (1 - threshold))  # len / (k + 1), rounded up
    windows = rest.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.length("n"), F.lit(longest))))).withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.length("n") - F.col("len")))
    ).withColumn("piece", F.substr(F.col("n"), F.col("at") + 1, F.col("len")))
    pairs = (
        windows.filter("n <> ''").join(pieces.drop("len"), "piece")
        .filter((F.abs(F.col("at") - F.col("off")) <= F.col("k")) & (
            F.least(F.length("n"), F.length("l")) > F.greatest(F.length("n"), F.length("l")) * threshold))
        .select("name", "n", "pos", "legit", "l").distinct()
        .withColumn("sim", normalized_levenshtein(F.col("n"), F.col("l")))
        .filter(F.col("sim") > threshold)
    )
    best = pairs.groupBy("name").agg(F.max_by(F.struct("legit", "sim"), F.struct("sim", -F.col("pos"))).alias("_b"))
    edited = best.select("name", F.col("_b.legit").alias("likely_target"), F.col("_b.sim").alias("similarity"))
    return swapped.unionByName(edited)
