"""Ranked lexical search over norm buckets.

A document is a vector of term impacts, an item is a vector over its terms, and a score is their inner product. Impact vectors are dealt
over tasks by their length and pass through a task longest first, in buckets. An item skips a bucket if the product of lengths
(Cauchy-Schwarz) is below its worst score so far. Inside a bucket its heaviest coordinates are added up until the rest, bounded by the
bucket's greatest coordinates and by the lengths that are left, can't reach that score; rows that stay possible are scored again
exactly in whole numbers. The longest vectors are searched first and give every task the scores to beat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import LOWER, short_batches, table, text_chunks, write_cut

#: Results of an item.
TOP = 10
#: Terms of items, repeats counted, that are searched in one go (sent to every task); more items are searched in several goes.
ITEM_TERMS = 500_000
#: Rows of a bucket, entries after which a bucket is closed, rows of a task, and rows that are searched first.
BUCKET, ENTRIES, TASK_ROWS, SEEDS = 8_192, 1 << 20, 40_000, 4_000
#: Terms added up between two looks at what is left.
STEP = 4

# Characters outside terms, and the letters that are lower-cased.
TERM_PATTERN = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_NO_ID = (1 << 63) - 1


def terms(text: Column) -> Column:
    """Terms of a text, repeats included; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWERED), F.lit(TERM_PATTERN)), F.array().cast("array<string>"))


# ---------------------------------------------------------------- items and the index


def item_blocks(items: DataFrame, most: int = ITEM_TERMS) -> Iterator[list[tuple[int | None, list[str]]]]:
    """[(item_id, distinct terms)] of all items, at most so many terms at a time (or one item)."""
    pairs = write_cut(items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(F.col("text"))).alias("term")).distinct())
    blocks = max(1, -(-pairs.count() // most))
    while True:
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
        sizes = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("item_id", F.lit(0)), F.isnull("item_id")).alias("items"))
        if not sizes.where((F.col("n") > most) & (F.col("items") > 1)).take(1) or blocks >= 1 << 24:
            break
        blocks *= 2
    for (block,) in sizes.select("block").orderBy("block").toLocalIterator():
        held = dealt.where(F.col("block") == block).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
        yield sorted(((r["item_id"], r["terms"]) for r in held.collect()), key=lambda x: (x[0] is None, x[0]))


def index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc, n, terms, tfs) of every row with a term: its id, the number of its terms, and which of the vocabulary it holds how often."""
    known = {t.encode(): k for k, t in enumerate(vocabulary)}
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            for low, high, words in text_chunks(batch.column(1), _OUTSIDE):
                numbers, kinds = words.coded(LOWER)
                codes = np.array([sent.value.get(k, -1) for k in kinds], np.int64)[numbers] if len(kinds) else np.zeros(0, np.int64)
                hit = codes >= 0
                both, tfs = np.unique(words.owners()[hit] * np.int64(len(known) or 1) + codes[hit], return_counts=True)
                rows, found = both // (len(known) or 1), both % (len(known) or 1)
                ends = np.searchsorted(rows, np.arange(high - low + 1))
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(words.counts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int64()))],
                    ["doc", "n", "terms", "tfs"],
                )
                yield out.filter(pa.array(words.counts > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    return rows.mapInArrow(run, "doc long, n long, terms array<int>, tfs array<long>")


def weights(held: np.ndarray, total: int) -> np.ndarray:
    """Weight of terms that so many of all documents hold."""
    return np.floor(1000 * np.log((2 * total + 2) / (2 * held + 1))).astype(np.int64)


def impacts(indexed: DataFrame, weight: np.ndarray, total: int, length: int) -> DataFrame:
    """(doc, terms, impacts, norm) of the rows that can score: the impact of a term is its part of a score without the weight; norm is
    the length of the vector of impacts, each times the root of its weight."""
    sent = indexed.sparkSession.sparkContext.broadcast(weight)

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            codes, tfs = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            m = 10 + (90 * batch.column(1).to_numpy() * total) // length
            values = (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, sizes))
            row = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.sqrt(np.bincount(row, sent.value[codes] * values.astype(float) ** 2, minlength=len(sizes)))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(codes, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(values, pa.int64())), pa.array(norm)], ["doc", "terms", "impacts", "norm"])
            yield out.filter(pa.array(norm > 0))

    return indexed.mapInArrow(run, "doc long, terms array<int>, impacts array<long>, norm double")


# ---------------------------------------------------------------- buckets


class Items:
    """Items as vectors over the vocabulary: q is the root of a term's weight."""

    def __init__(self, own: list[np.ndarray], weight: np.ndarray):
        self.weight, self.root = weight, np.sqrt(weight.astype(float))
        self.own = own
        self.norm = np.array([np.sqrt(weight[t].sum()) for t in own] or [0.0])


class Best:
    """The k best (score, doc) of each item, greater scores first, then smaller ids, null ids last; floor is the score to reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.astype(float), k
        self.rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def offer(self, item: int, scores: np.ndarray, docs: np.ndarray, none: np.ndarray) -> None:
        good = scores >= max(self.floor[item], 1)
        if not good.any():
            return
        scores, docs, none = scores[good], docs[good], none[good]
        if item in self.rows:
            scores, docs, none = (np.concatenate([a, b]) for a, b in zip(self.rows[item], (scores, docs, none), strict=True))
        order = np.lexsort((docs, none, -scores))[: self.k]
        self.rows[item] = scores[order], docs[order], none[order]
        if len(order) == self.k:
            self.floor[item] = max(self.floor[item], float(scores[order[-1]]))


class Bucket:
    """Rows of about one length, by row and by coordinate."""

    def __init__(self, docs, none, norm, sizes, codes, values, root):
        self.docs, self.none, self.norm, self.longest = docs, none, norm, float(norm.max())
        self.starts, self.codes, self.values = np.concatenate([[0], np.cumsum(sizes)]), codes, values
        order = np.argsort(codes, kind="stable")
        self.rows = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.parts = (root[codes] * values)[order]
        self.kinds, self.first = np.unique(codes[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.most = np.maximum.reduceat(self.parts, self.first[:-1]) if len(order) else np.zeros(0)

    def possible(self, root: np.ndarray, own: np.ndarray, floor: float) -> np.ndarray:
        """Rows that may reach the floor against an item with terms own."""
        at = np.searchsorted(self.kinds, own)
        at = at[self.kinds[np.minimum(at, len(self.kinds) - 1)] == own]
        q = root[self.kinds[at]]
        bound = q * self.most[at]
        order = np.argsort(-bound, kind="stable")
        at, q = at[order], q[order]
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)  # by coordinates, of the terms from each place on
        left = np.sqrt(np.append(np.cumsum((q**2)[::-1])[::-1], 0.0))  # by lengths
        slack = 1e-9 * floor + 1e-3
        if rest[0] < floor - slack:
            return np.zeros(0, np.int64)
        score, used = np.zeros(len(self.docs)), np.zeros(len(self.docs))
        taken, live = 0, None
        while taken < len(at):
            for k in range(taken, min(taken + STEP, len(at))):
                a, b = self.first[at[k]], self.first[at[k] + 1]
                score[self.rows[a:b]] += q[k] * self.parts[a:b]
                used[self.rows[a:b]] += self.parts[a:b] ** 2
            taken = min(taken + STEP, len(at))
            others = np.minimum(rest[taken], left[taken] * np.sqrt(np.maximum(self.norm**2 * (1 + 1e-9) - used, 0)))
            live = np.flatnonzero((score + others >= floor - slack) & ((score > 0) | (rest[taken] > 0)))
            # once no row without a term so far can reach the floor, few rows are left and are scored at once
            if rest[taken] < floor - slack and len(live) * 8 < len(score):
                break
        return live if live is not None else np.zeros(0, np.int64)

    def exact(self, rows: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """Scores of rows against an item whose weights stand in marked."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        place = np.arange(int(ends[-1])) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return np.add.reduceat(marked[self.codes[place]] * self.values[place], ends - sizes)


def search_bucket(bucket: Bucket, items: Items, best: Best, marked: np.ndarray) -> None:
    """Offer the rows of a bucket to the items that can use them. marked is a row of zeros over the vocabulary."""
    for item in np.flatnonzero(items.norm * bucket.longest * (1 + 1e-9) + 1e-3 >= best.floor):
        own = items.own[item]
        rows = bucket.possible(items.root, own, float(best.floor[item]))
        if len(rows):
            marked[own] = items.weight[own]
            best.offer(int(item), bucket.exact(rows, marked), bucket.docs[rows], bucket.none[rows])
            marked[own] = 0


def _buckets(batches, root: np.ndarray) -> Iterator[Bucket]:
    held, rows, entries = [], 0, 0

    def close():
        whole = pa.concat_batches(held)
        docs = whole.column(0)
        return Bucket(
            docs.fill_null(_NO_ID).to_numpy(), docs.is_null().to_numpy(zero_copy_only=False), whole.column(3).to_numpy(), np.diff(whole.column(1).offsets.to_numpy()),
            whole.column(1).flatten().to_numpy(), whole.column(2).flatten().to_numpy(), root,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, entries = rows + batch.num_rows, entries + len(batch.column(1).flatten())
        if rows >= BUCKET or entries >= ENTRIES:
            yield close()
            held, rows, entries = [], 0, 0
    if held:
        yield close()


def _searched(vectors: DataFrame, items, floor: np.ndarray, k: int) -> DataFrame:
    """(item, doc, score) of the k best rows of each task for each item, from vectors that pass longest first."""
    sent = vectors.sparkSession.sparkContext.broadcast(floor)

    def run(batches):
        own = items.value
        best, marked = Best(sent.value, k), np.zeros(len(own.weight), np.int64)
        for bucket in _buckets(batches, own.root):
            search_bucket(bucket, own, best, marked)
        for item, (scores, docs, none) in best.rows.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item), pa.int32()), pa.array(docs, pa.int64(), mask=none), pa.array(scores, pa.int64())], ["item", "doc", "score"])

    return vectors.sortWithinPartitions(F.desc("norm")).mapInArrow(run, "item int, doc long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: list[tuple[int | None, list[str]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, own in block for t in own})
    code = {t: c for c, t in enumerate(vocabulary)}
    indexed = write_cut(index(docs, vocabulary))
    total, length = indexed.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    held = np.zeros(len(vocabulary), np.int64)
    for term, n in indexed.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the vocabulary
        held[term] = n
    weight = weights(held, total)
    vectors = write_cut(impacts(indexed, weight, total, length))
    items = spark.sparkContext.broadcast(Items([np.array(sorted(code[t] for t in own), np.int64) for _, own in block], weight))
    rows = vectors.count()
    # the longest vectors give the scores to beat
    cut = vectors.agg(F.percentile_approx("norm", max(0.0, 1 - SEEDS / max(rows, 1)), 10_000)).first()[0]
    tasks = max(1, -(-rows // TASK_ROWS))
    seeds = write_cut(_ranked(_searched(vectors.where(F.col("norm") >= cut), items, np.zeros(len(block)), k), k)) if rows else None
    floor = np.zeros(len(block))
    if seeds is not None:
        for item, score in seeds.where(F.col("rank") == k).select("item", "score").collect():  # one row for an item
            floor[item] = score
        # rows of one length are dealt over several tasks by their ids
        dealt = vectors.where(F.col("norm") < cut).repartitionByRange(tasks, F.desc("norm"), F.xxhash64("doc", "terms"))
        found = seeds.drop("rank").unionByName(_searched(dealt, items, floor, k))
    else:
        found = spark.createDataFrame([], "item int, doc long, score long")
    named = spark.createDataFrame([(n, item_id) for n, (item_id, _) in enumerate(block)], "item int, item_id long")
    return _ranked(found, k).join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of (item_id, text) the k rows of docs (doc_id, text) with the highest scores above 0,
    equal scores by doc_id; all of them if there are fewer.

    A score sums weight * impact over the item's distinct terms. Odd rows: null, empty and term-free texts take no part; rows of items
    with one id (null too) are one item with the terms of all; every row of docs is a document, repeated ids and rows too, and null
    ids come last among equal scores; texts of any length are read whole; other columns are not read; empty tables give no rows."""
    spark = docs.sparkSession
    short_batches(spark)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items):
        out = out.unionByName(_search_block(docs.select("doc_id", "text"), block, k))
    return out


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM words WHERE len(w) > 0),
stats AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS l FROM docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counts AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS wt FROM (SELECT term, count(*)::BIGINT AS df FROM counts GROUP BY term), stats),
parts AS (
  SELECT c.r, c.term, wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l))) AS part
  FROM counts c JOIN weights USING (term) JOIN docs USING (r), stats),
scores AS (SELECT item_id, r, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY item_id, r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
  FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""

QUERIES = {"op11_lexical_search": op11_lexical_search}
ORACLES = {"op11_lexical_search": OP11_SQL}
