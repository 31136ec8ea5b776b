"""Toxicity by class-conditional Kneser-Ney models.

Both classes have interpolated, absolutely discounted models of words. A rare word backs off to its stem (first five bytes), the
stem to a shorter one (four bytes), and that to a distribution gathered from both classes. As in Kneser-Ney, the lower orders count
kinds, not occurrences: a stem counts the different words it begins. A text's evidence is the length-normalised difference of
its log-likelihoods under both classes, in total and by strength of the word; a logistic curve, fitted across two halves of the
training rows, turns it into a score.

Counts come from all labelled training rows and are rows of Spark tables, one for each word, stem and short stem by its 64-bit hash,
so they grow with the vocabulary and no two words share one. What texts are scored with is a table of log ratios: those of the words
and stems whose counts are above the discount (the others score as if unseen, without loss) and of all short stems. It is broadcast
up to RATIO_ROWS rows and met in shuffle joins beyond that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from auditlake.llm.common import LOWER, Words, learns, lookup, short_batches, span_hashes, table, text_chunks, write_cut

#: Short stems over which the last distribution is spread at least; more if more are seen.
STEMS = 1 << 18
#: Log ratios (12 bytes each) up to which a model is broadcast; beyond that words meet it in shuffle joins.
RATIO_ROWS = 8_000_000
#: Discounts of words and of kinds; a ratio is cut off at MOST.
DISCOUNT, KIND_DISCOUNT, MOST = 1.5, 1.5, 6.0
#: Closing marks taken off a word.
MARKS = 4
#: Score from which a document counts as toxic.
CUT = 0.7
#: Labels of these rows are never learnt: crc32 of the id modulo FOLDS is HELD.
FOLDS, HELD = 3, 1
#: Labelled rows (8 bytes and a flag each) up to which they are broadcast; beyond that they meet the texts in a shuffle join.
LABEL_ROWS = 1_000_000
#: Penalty on the curve's slopes.
RIDGE = 0.1


def _keys(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, their stems and their short stems; case and closing marks are ignored."""
    data, starts, ends = LOWER[words.data], words.starts, words.ends.copy()
    for _ in range(MARKS):
        last = data[np.maximum(ends - 1, 0)]
        ends = ends - (((last < 48) | ((last > 57) & (last < 97)) | ((last > 122) & (last < 128))) & (ends - starts > 1))
    return tuple(span_hashes(data, starts, to).view(np.int64) for to in (ends, np.minimum(ends, starts + 5), np.minimum(ends, starts + 4)))


# ---------------------------------------------------------------- counts and models

#: Sides (fold and label) that a model counts, for each class: fold 0, fold 1, both.
_SIDES = (((0,), (1,)), ((2,), (3,)), ((0, 2), (1, 3)))


def count_words(labelled: DataFrame) -> DataFrame:
    """(word, stem, short, n0 .. n3) of every word of labelled (text, __label, __fold): its hashes and its occurrences by side, which
    is twice the fold and the label."""

    def count(batches):
        for batch in batches:
            label, fold = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            side = 2 * fold + label
            for low, _, words in text_chunks(batch.column(0)):
                keys, of = _keys(words), side[words.owners() + low]
                for k in np.unique(of):
                    mine = np.flatnonzero(of == k)
                    _, first, n = np.unique(keys[0][mine], return_index=True, return_counts=True)
                    first = mine[first]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x[first], pa.int64()) for x in keys), pa.array(np.full(len(n), k), pa.int32()), pa.array(n, pa.int64())], ["word", "stem", "short", "side", "n"]
                    )

    parts = labelled.select("text", "__label", "__fold").mapInArrow(count, "word long, stem long, short long, side int, n long")
    sides = (F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4))
    return parts.groupBy("word").agg(F.min("stem").alias("stem"), F.min("short").alias("short"), *sides)


class Counts:
    """Tables of words, of stems and of short stems. The latter two hold the kinds of each model and class as k00, k01 .. k21."""

    def __init__(self, labelled: DataFrame):
        self.words = write_cut(count_words(labelled))
        kinds = [F.sum((self.counted(m, c) > 0).cast("long")).alias(f"k{m}{c}") for m in range(3) for c in (0, 1)]
        self.stems = write_cut(self.words.groupBy("stem").agg(F.min("short").alias("short"), *kinds))
        self.shorts = write_cut(self.stems.groupBy("short").agg(*(F.sum(f"k{m}{c}").alias(f"k{m}{c}") for m in range(3) for c in (0, 1))))

    def counted(self, model: int, label: int) -> Column:
        """Occurrences of a word in a model's texts of one class."""
        return sum((F.col(f"n{k}") for k in _SIDES[model][label]), F.lit(0))

    def ratios(self, model: int) -> tuple[DataFrame, float]:
        """(level, key, ratio): log-likelihood ratios (toxic over ordinary) of words (level 0), stems (1) and short stems (2) with the
        hash key, each the one of a word that none of the levels before it holds; and the ratio of a word that no level holds."""
        n, k = [self.counted(model, c) for c in (0, 1)], [F.col(f"k{model}{c}") for c in (0, 1)]
        whole = lambda rows, of, cut: rows.agg(
            *(F.sum(x.cast("double")).alias(f"all{c}") for c, x in enumerate(of)), *(F.sum(F.least(x.cast("double"), F.lit(cut))).alias(f"cut{c}") for c, x in enumerate(of)),
            F.count(F.when(of[0] + of[1] > 0, 1)).alias("rows"),
        ).first()
        word, stem, short = whole(self.words, n, DISCOUNT), whole(self.stems, k, KIND_DISCOUNT), whole(self.shorts, k, KIND_DISCOUNT)
        every = lambda row, c: max(row[f"all{c}"] or 0.0, 1.0)
        left = lambda row, c: max((row[f"cut{c}"] or 0.0) / every(row, c), 1e-6)
        above = lambda x, cut, row, c: F.greatest(x - F.lit(cut), F.lit(0.0)) / F.lit(every(row, c))
        spread = (short["all0"] or 0.0) + (short["all1"] or 0.0) + 0.1 * max(STEMS, short["rows"] + 1)
        kinds = k[0] + k[1] + F.lit(0.1)
        ratio = lambda chance: F.greatest(F.least(F.log(chance[1] / chance[0]), F.lit(MOST)), F.lit(-MOST)).cast("float")
        back = [left(word, c) for c in (0, 1)]
        # chances after the stem's size is divided out; it cancels in what a stem hands down to its short stem
        shorts = self.shorts.where(k[0] + k[1] > 0).select(
            "short", *((F.lit(left(stem, c)) * (above(k[c], KIND_DISCOUNT, short, c) + F.lit(left(short, c)) * kinds / F.lit(spread)) / kinds).alias(f"s{c}") for c in (0, 1))
        )
        stems = self.stems.where(k[0] + k[1] > 0).join(shorts, "short").select(
            "stem", F.greatest(*k).alias("most"), *((above(k[c], KIND_DISCOUNT, stem, c) / kinds + F.col(f"s{c}")).alias(f"t{c}") for c in (0, 1))
        )
        words = self.words.where(F.greatest(*n) > DISCOUNT).join(stems, "stem")
        rows = words.select(F.lit(0).alias("level"), F.col("word").alias("key"), ratio([above(n[c], DISCOUNT, word, c) + F.lit(back[c]) * F.col(f"t{c}") for c in (0, 1)]).alias("ratio"))
        rows = rows.unionAll(stems.where(F.col("most") > KIND_DISCOUNT).select(F.lit(1), "stem", ratio([F.lit(back[c]) * F.col(f"t{c}") for c in (0, 1)])))
        rows = rows.unionAll(shorts.select(F.lit(2), "short", ratio([F.lit(back[c]) * F.col(f"s{c}") for c in (0, 1)])))
        unseen = [back[c] * left(stem, c) * left(short, c) for c in (0, 1)]
        return write_cut(rows), float(np.clip(np.log(unseen[1] / unseen[0]), -MOST, MOST))


class Model:
    """Log ratios on the driver and in tasks, as sorted keys by level."""

    def __init__(self, rows: DataFrame, unseen: float):
        found = rows.toArrow()
        level, key, ratio = (found.column(k).to_numpy() for k in ("level", "key", "ratio"))
        self.levels, self.unseen = [], unseen
        for k in range(3):
            mine = np.flatnonzero(level == k)
            mine = mine[np.argsort(key[mine])]
            self.levels.append((key[mine].astype(np.int64), ratio[mine].astype(np.float32)))

    def ratios(self, words: Words) -> np.ndarray:
        keys = _keys(words)
        _, first, again = np.unique(keys[0], return_index=True, return_inverse=True)
        out, open_ = np.full(len(first), self.unseen), np.arange(len(first))
        for of, (known, ratio) in zip(keys, self.levels, strict=True):
            if len(known) and len(open_):
                wanted = of[first[open_]]
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = known[at] == wanted
                out[open_[hit]] = ratio[at[hit]]
                open_ = open_[~hit]
        return out[again]

    def evidence(self, words: Words) -> np.ndarray:
        """For each text the mean ratio, and what words beyond one half and beyond one third of MOST add to the mean; zeros for a
        text without words."""
        ratios = self.ratios(words)
        out = []
        for part in (ratios, np.where(ratios > MOST / 2, ratios, 0), np.where((ratios > MOST / 6) & (ratios <= MOST / 2), ratios, 0)):
            sums = np.concatenate([[0.0], np.cumsum(part)])
            out.append((sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(words.counts, 1))
        return np.stack([out[0], np.log1p(50 * out[1]), np.log1p(50 * out[2])], 1)


def _joined_evidence(docs: DataFrame, ratios: DataFrame, unseen: float, name: str) -> DataFrame:
    """The same as Model.evidence for a table of ratios that is too long to be sent: different words of each text meet it level by
    level."""

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_numpy()
            for low, _, words in text_chunks(batch.column(0)):
                keys, owner = _keys(words), words.owners()
                order = np.lexsort((keys[0], owner))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(owner[order]) != 0) | (np.diff(keys[0][order]) != 0)
                at = np.flatnonzero(new)
                first, n = order[at], np.diff(np.append(at, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[owner[first] + low], pa.int64()), *(pa.array(x[first], pa.int64()) for x in keys), pa.array(n, pa.int64())], ["__row", "k0", "k1", "k2", "times"]
                )

    numbered = write_cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    met = numbered.select("text", "__row").mapInArrow(run, "__row long, k0 long, k1 long, k2 long, times long")
    for k in range(3):
        met = lookup(met, ratios.where(F.col("level") == k).select(F.col("key").alias(f"k{k}"), F.col("ratio").alias(f"r{k}")), [f"k{k}"])
    r = F.coalesce("r0", "r1", "r2", F.lit(unseen)).cast("double")
    parts = (r, F.when(r > MOST / 2, r).otherwise(0.0), F.when((r > MOST / 6) & (r <= MOST / 2), r).otherwise(0.0))
    sums = met.groupBy(F.col("__row").alias("__at")).agg(*((F.sum(x * F.col("times")) / F.sum("times")).alias(f"__e{k}") for k, x in enumerate(parts)))
    mean = [F.coalesce(f"__e{k}", F.lit(0.0)) for k in range(3)]
    joined = numbered.join(sums, F.col("__row") == F.col("__at"), "left")
    return joined.select(*docs.columns, F.array(mean[0], F.log1p(50 * mean[1]), F.log1p(50 * mean[2])).alias(name))


def _evidence(docs: DataFrame, model: tuple[DataFrame, float], name: str) -> DataFrame:
    """docs with an array column of evidence."""
    if model[0].count() > RATIO_ROWS:
        return _joined_evidence(docs, *model, name)
    sent = docs.sparkSession.sparkContext.broadcast(Model(*model))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [sent.value.evidence(words) for _, _, words in text_chunks(batch.column(at))]
            values = pa.array(np.concatenate(found).tolist() if found else [], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(name, ArrayType(DoubleType())))


def _curve(rows: DataFrame, rounds: int = 15) -> np.ndarray:
    """Logistic curve (intercept and slopes) on the evidence by Newton steps; each step sums a few numbers over all rows."""
    x = [F.lit(1.0), *(F.col("e")[k] for k in range(3))]
    theta = np.zeros(len(x))
    for _ in range(rounds):
        z = sum((F.lit(float(t)) * c for t, c in zip(theta, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        step = rows.withColumn("p", p).agg(
            *(F.sum((F.col("y") - F.col("p")) * c).alias(f"g{i}") for i, c in enumerate(x)),
            *(F.sum(F.col("p") * (1 - F.col("p")) * x[i] * x[j]).alias(f"h{i}{j}") for i in range(len(x)) for j in range(i, len(x))),
        ).first()
        if step["g0"] is None:
            return theta
        g = np.array([step[f"g{i}"] for i in range(len(x))]) - RIDGE * theta
        h = np.array([[step[f"h{min(i, j)}{max(i, j)}"] for j in range(len(x))] for i in range(len(x))]) + RIDGE * np.eye(len(x))
        move = np.linalg.solve(h, g)
        theta = theta + np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-2:
            break
    return theta


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> tuple[tuple[DataFrame, float], np.ndarray]:
    """Model (its ratios and the one of unseen words) and curve from all labelled training rows. The curve is fitted on each half's rows under the other half's counts. Null
    labels are left out, of repeated labels the greater counts; without training rows every text scores one half."""
    short_batches(docs.sparkSession)
    rows = labels.select("doc_id", target).where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).where(learns(F.col("doc_id"), FOLDS, HELD))
    known = rows.groupBy("doc_id").agg((F.max(target) > 0).cast("int").alias("__label"))
    known = F.broadcast(known) if known.count() <= LABEL_ROWS else known
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int")
    labelled = docs.select("doc_id", "text").join(known, "doc_id").withColumn("__fold", fold)
    counts = Counts(labelled)
    crossed = [
        _evidence(labelled.where(F.col("__fold") == f).select("text", "__label"), counts.ratios(1 - f), "e").select("e", F.col("__label").alias("y")) for f in (0, 1)
    ]
    curve = _curve(write_cut(crossed[0].unionAll(crossed[1])))
    return counts.ratios(2), curve


def score(docs: DataFrame, model: tuple[DataFrame, float], curve: np.ndarray) -> DataFrame:
    """docs with a new column __score (0 to 1) for the whole text. Nulls count as empty; a text without words has the score of no
    evidence; other columns pass through."""
    z = sum((F.lit(float(slope)) * F.col("__e")[k] for k, slope in enumerate(curve[1:])), F.lit(float(curve[0])))
    return _evidence(docs, model, "__e").withColumn("__score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).drop("__e")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    scored = score(docs.select("doc_id", "text"), *train(docs, labels))
    return scored.select(
        "doc_id", (~learns(F.col("doc_id"), FOLDS, HELD)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= CUT).cast("int").alias("predicted")
    )


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return rate(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
