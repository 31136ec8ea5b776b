"""Quality rules with thresholds that adapt to language and source, from mergeable quantile sketches.

Each signal of a document falls into a bucket of whole numbers kept to seven significant bits (relative error below 1/64). The
counts by (language, source, signal, bucket) are the sketch: two sketches merge by adding counts, and a quantile is read by
running over at most a few thousand buckets. A document goes if a signal lies beyond the fence of its own group, far outside the
spread between the group's quartiles. Everything is DataFrame functions; the sketch join carries numbers only, no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import SPACES, lookup, table, words, write_cut

# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition is counted.
WINDOW = 5
#: Fence: quartile plus or minus this many times the spread between the quartiles (or the least spread of the signal, if larger).
REACH = 4
#: Signals in whole numbers: symbols and repeated lines per thousand word characters and lines, repeated words per thousand words,
#: word characters per hundred words. With each: least spread, and whether low values are odd too.
SIGNALS = {"symbols": (20, False), "dup_lines": (60, False), "repeats": (40, False), "word_length": (100, True)}


def _window_hashes(tokens: Column) -> Column:
    """Hash of the window from each word on; null for a text shorter than a window."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (WINDOW - 1))
    return F.when(F.size(tokens) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, WINDOW))))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs at least twice. Hashes are first tested for any repetition, which few texts have;
    only then are they sorted with their places, so the work stays below n log n."""
    size = F.size(hashes)
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(
        F.size(F.array_distinct(hashes)) < size,
        # a place counts if the hash before or after it in sorted order is its own
        F.aggregate(
            F.array_sort(
                F.filter(
                    F.transform(
                        F.arrays_zip(ordered.alias("a"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(ordered, 1, size - 1)).alias("b"),
                                     F.concat(F.slice(ordered, 2, size), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))).alias("c")),
                        lambda x: F.when((x["a"]["h"] == x["b"]["h"]) | (x["a"]["h"] == x["c"]["h"]), x["a"]["i"]),
                    ),
                    lambda i: i.isNotNull(),
                )
            ),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        ),
    ).otherwise(F.lit(0).cast("long"))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    counted = docs.select(
        "doc_id", "lang", "source", words(text).alias("tokens"), lines.alias("lines"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    hashed = counted.select(
        "doc_id", "lang", "source", F.size("tokens").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _window_hashes(F.col("tokens")).alias("hashes"),
    )
    return hashed.select(*(c for c in hashed.columns if c != "hashes"), F.coalesce(_covered(F.col("hashes")), F.lit(0).cast("long")).alias("n_repeat_words"))


def signals(counts: DataFrame) -> DataFrame:
    """counts with base_failed and the signals as whole numbers; null where there is nothing to divide by."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.withColumns({
        "base_failed": base,
        "symbols": F.expr("CASE WHEN word_chars > 0 THEN 1000 * n_symbols div word_chars END"),
        "dup_lines": F.expr("CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines div n_lines END"),
        "repeats": F.expr("CASE WHEN n_words > 0 THEN 1000 * n_repeat_words div n_words END"),
        "word_length": F.expr("CASE WHEN n_words > 0 THEN 100 * word_chars div n_words END"),
    })


def bucket(value: Column) -> Column:
    """Value cut to seven significant bits: at most 64 buckets for each doubling."""
    drop = F.greatest(F.length(F.bin(value)).cast("int") - 7, F.lit(0))
    return F.expr("0L") + F.floor(value / F.pow(F.lit(2.0), drop)).cast("long") * F.pow(F.lit(2.0), drop).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, signal, bucket, n): the sketches of all groups, over documents that pass the base rules. Partial counts are
    merged before the shuffle, so a hot group sends a bounded number of rows from each task."""
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), F.col(k).alias("value")) for k in SIGNALS)))
    rows = measured.where(~F.col("base_failed")).select("lang", "source", values.alias("s")).where("s.value IS NOT NULL")
    return rows.groupBy("lang", "source", F.col("s.signal").alias("signal"), bucket(F.col("s.value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """One sketch table from several, for example from runs over parts of a corpus."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("lang", "source", "signal", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source) with a struct low and high for each signal. Quartiles are the buckets in which a quarter
    and three quarters of the group are reached; a window sees the buckets of one group and signal, whose number is fixed."""
    group = Window.partitionBy("lang", "source", "signal")
    upto = F.sum("n").over(group.orderBy("bucket"))
    placed = sketch.withColumn("upto", upto).withColumn("all", F.sum("n").over(group))
    quarter = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bucket")))
    quartiles = placed.groupBy("lang", "source", "signal").agg(quarter(1).alias("q1"), quarter(3).alias("q3"))
    least = F.coalesce(*(F.when(F.col("signal") == k, F.lit(v[0])) for k, v in SIGNALS.items()))
    spread = REACH * F.greatest(F.col("q3") - F.col("q1"), least)
    ends = quartiles.withColumn("fence", F.struct((F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high")))
    picked = [F.max(F.when(F.col("signal") == k, F.col("fence"))).alias(f"{k}_fence") for k in SIGNALS]
    return ends.groupBy("lang", "source").agg(*picked)


def judge(docs: DataFrame) -> DataFrame:
    """One row for each document: its counts, base_failed, and kept.

    kept is false if a base rule fails (fewer than ten words, or more than a fifth of them inside repeated windows) or a signal lies
    beyond the fence of the document's own language and source. Odd rows: null and empty texts have no words and fail; null languages
    and sources are groups of their own; a group without a passing document has no fences and judges by the base rules alone;
    repeated rows count each; an empty table gives no rows; other columns of docs are not read."""
    measured = write_cut(signals(base_counts(docs.select("doc_id", "text", "lang", "source"))))
    judged = lookup(measured, write_cut(fences(sketches(measured))), ["lang", "source"])
    odd = F.lit(False)
    for name, (_, low) in SIGNALS.items():
        beyond = F.col(name) > F.col(f"{name}_fence.high")
        odd = odd | F.coalesce(beyond | (F.col(name) < F.col(f"{name}_fence.low")) if low else beyond, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~odd)


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents")).select(*RESULT)


def _sql() -> str:
    """The same by plain means: windows are rows, quartiles come from ordering all documents of a group."""
    cut = "(({v}) >> greatest(length(bin({v})) - 7, 0)) << greatest(length(bin({v})) - 7, 0)"
    values = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS signal, {cut.format(v=k)} AS b FROM measured WHERE NOT base_failed AND {k} IS NOT NULL" for k in SIGNALS)
    least = " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in SIGNALS.items())
    odd = " OR ".join(
        f"coalesce((SELECT m.{k} > f.high{f' OR m.{k} < f.low' if v[1] else ''} FROM fences f WHERE f.signal = '{k}' AND f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source), false)"
        for k, v in SIGNALS.items()
    )
    return f"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x : regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i:i+4] AS g FROM texts, LATERAL (SELECT unnest(generate_series(1, len(w) - 4)) AS i)),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id),
measured AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars END AS symbols, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END AS dup_lines,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END AS repeats, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS word_length
  FROM counts),
vals AS ({values}),
quartiles AS (
  SELECT lang, source, signal, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM vals GROUP BY lang, source, signal),
fences AS (
  SELECT *, q1 - {REACH} * greatest(q3 - q1, CASE signal {least} END) AS low, q3 + {REACH} * greatest(q3 - q1, CASE signal {least} END) AS high FROM quartiles)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({odd}) AS kept FROM measured m
"""


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": _sql()}
