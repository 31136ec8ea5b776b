"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are hashes of words and word pairs, both as written and as shapes (runs of letters, capitals, digits and each other
character; a pair of shapes also tells whether the two words are the same). A feature's value is its share of the text's n-grams, so a score is a sparse dot product: the mean weight over the
text's n-grams. Training rows are a bounded sample of the labelled ones; shards of it are trained apart and their weights averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import Words, grams, inside, learns, short_batches, span_hashes, table, text_chunks

#: Weights (a power of two), labelled rows used for training at most (expected number of a hash sample), shards and passes.
DIMENSIONS, SAMPLE, SHARDS, PASSES = 1 << 18, 20_000, 8, 4
#: Learning rate, its smoothing, and the two penalties of the updates; scale of the features.
ALPHA, BETA, L1, L2, SCALE = 2.0, 1.0, 1e-3, 1e-4, 100.0
#: Score from which a document counts as good.
CUT = 0.3
#: Labels of these rows are never learnt: crc32 of the id modulo FOLDS is HELD.
FOLDS, HELD = 5, 0

_SHAPES = np.arange(256, dtype=np.uint8)
_SHAPES[97:123] = 97
_SHAPES[65:91] = 65
_SHAPES[48:58] = 48
_SHAPES[128:] = 97
_KINDS = 0x9E3779B97F4A7C15


def _shape_hashes(words: Words) -> np.ndarray:
    """Hash of each word's shape, runs of one class counted once."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    classes = _SHAPES[words.data]
    keep = np.ones(len(classes), bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[words.starts] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    return span_hashes(classes[keep], upto[words.starts], upto[words.ends])


def features(words: Words, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram occurrence of the texts, in no particular order."""
    owner, rows, slots = words.owners(), [], []
    written = words.hashes()
    same = np.append((written[1:] == written[:-1]) & (owner[1:] == owner[:-1]), False).astype(np.uint64) if len(written) else written
    for kind, hashes in enumerate((written, _shape_hashes(words))):
        for n in (1, 2):
            whole = inside(words, n)
            if kind and n == 2:
                hashes = hashes ^ same
            salt = np.uint64((2 * kind + n) * _KINDS % 2**64)
            rows.append(owner[: len(whole)][whole])
            slots.append(((grams(hashes, n)[whole] ^ salt) % np.uint64(dimensions)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(slots)


# ---------------------------------------------------------------- training


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], dimensions: int = DIMENSIONS, passes: int = PASSES) -> np.ndarray:
    """Weights (the last is the intercept) after passes over (features, values, label)."""
    z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)

    def weights(at):
        zi, ni = z[at], n[at]
        free = np.sign(zi) * np.maximum(np.abs(zi) - L1, 0)
        return -free / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    order = np.random.default_rng(1)
    for _ in range(passes):
        for k in order.permutation(len(examples)):
            at, x, y = examples[k]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(dimensions + 1))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights from labelled rows (doc_id, target) joined to docs (doc_id, text). About sample rows are used, those with the
    smallest hashes of their ids; the sample is bounded, so its ids are broadcast and no text is shuffled but its features are.
    Null labels and rows without a text are left out, of repeated labels the greater counts, all rows of a repeated id are examples,
    other columns are not read; with a single class, or empty tables, the intercept alone is learnt or stays 0."""
    short_batches(docs.sparkSession)
    rows = labels.select("doc_id", target).where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).where(learns(F.col("doc_id"), FOLDS, HELD))
    known = rows.groupBy("doc_id").agg((F.max(target) > 0).cast("int").alias("__label"))
    parts = max(1.0, known.count() / sample)
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) / parts))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    shard = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SHARDS)).cast("int")
    chosen = texts.select("text", "__label", shard.alias("shard"), "doc_id")

    def encode(batches):
        for batch in batches:
            for low, high, words in text_chunks(batch.column(0)):
                owner, slots = features(words)
                keys, counts = np.unique(owner * np.int64(DIMENSIONS) + slots, return_counts=True)
                edges = np.searchsorted(keys // DIMENSIONS, np.arange(high - low + 1))
                every = np.diff(np.searchsorted(np.sort(owner), np.arange(high - low + 1)))
                found = [(keys[a:b] % DIMENSIONS).astype(np.int32) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                values = [(SCALE * counts[a:b] / max(1, t)).astype(np.float32) for a, b, t in zip(edges[:-1], edges[1:], every, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(low, high - low), batch.column(1).slice(low, high - low), batch.column(3).slice(low, high - low).cast(pa.int64()),
                     pa.array([f.tobytes() for f in found], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())],
                    ["shard", "label", "doc", "at", "x"],
                )

    encoded = chosen.mapInArrow(encode, "shard int, label int, doc long, at binary, x binary")

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc")  # the updates depend on the order
        examples = [
            (np.append(np.frombuffer(at, np.int32), DIMENSIONS).astype(np.int64), np.append(np.frombuffer(x, np.float32), 1.0).astype(float), y)
            for at, x, y in zip(rows.column("at").to_pylist(), rows.column("x").to_pylist(), rows.column("label").to_pylist(), strict=True)
        ]
        return pa.table({"weights": pa.array([ftrl(examples).astype(np.float32).tobytes()], pa.binary())})

    trained = [np.frombuffer(r["weights"], np.float32) for r in encoded.groupBy("shard").applyInArrow(learn, "weights binary").sort(F.md5("weights")).collect()]
    return np.mean(trained, axis=0) if trained else np.zeros(DIMENSIONS + 1, np.float32)


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with a new column __score (0 to 1), which replaces one of this name, for the whole text; a text without words has the score of
    the intercept. Nulls count as empty, repeated rows and ids are scored row by row, an empty table stays empty, other columns pass
    through. The weights have a fixed size and go to every task."""
    short_batches(docs.sparkSession)
    docs = docs.drop("__score")
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for low, high, words in text_chunks(batch.column(at)):
                owner, slots = features(words)
                n = high - low
                total = np.bincount(owner, weights=sent.value[slots], minlength=n)
                grams_of = np.bincount(owner, minlength=n)
                scores[low:high] = SCALE * total / np.maximum(grams_of, 1) + sent.value[-1]
            chance = 1 / (1 + np.exp(-np.clip(scores, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance, pa.float64())], [*batch.schema.names, "__score"])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("__score", "double"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", (~learns(F.col("doc_id"), FOLDS, HELD)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= CUT).cast("int").alias("predicted")
    )


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLES: dict[str, str] = {}
