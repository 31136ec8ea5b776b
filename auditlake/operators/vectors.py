"""Vector operators: token-weight embeddings, nearest patterns, message passing, deviation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import cosine, rms_deviation
from auditlake.session import write_cut

EMBEDDING_DIM = 128
DEFAULT_WEIGHT = 0.1
STRIDE = 7


# Token weights.
TOKEN_WEIGHTS = {
    "invoke": 0.9, "invoke_signed": 0.95, "AccountInfo": 0.8, "UncheckedAccount": 0.85, "authority": 0.7, "owner": 0.75,
    "signer": 0.8, "close": 0.7, "init_if_needed": 0.9, "lamports": 0.75, "transfer": 0.8, "mint_to": 0.85, "burn": 0.7,
    "set_authority": 0.9, "create_account": 0.6, "try_borrow_mut_lamports": 0.85, "try_borrow_mut_data": 0.7,
    "system_instruction": 0.65, "find_program_address": 0.7, "create_program_address": 0.75, "bump": 0.5, "seeds": 0.55,
    "rent_exempt": 0.4, "realloc": 0.65, "zero_copy": 0.5, "+": 0.5, "-": 0.5, "*": 0.6, "/": 0.6, "checked_add": -0.3,
    "checked_sub": -0.3, "checked_mul": -0.3, "checked_div": -0.3, "saturating_add": -0.25, "saturating_sub": -0.25,
    "saturating_mul": -0.25, "require!": -0.4, "require_keys_eq!": -0.5, "has_one": -0.4, "constraint": -0.35,
    "assert_eq!": -0.3,
}


#: Lines whose vectors are made at once, and patterns that go to every task at once.
LINES, PATTERNS = 8_192, 4_096


def line_vectors(lines: pa.Array, weights: dict[str, float] = TOKEN_WEIGHTS, dim: int = EMBEDDING_DIM) -> np.ndarray:
    """Unit vector of each line: the weight of its i-th token (split at non-alphanumerics) goes to place 7*i mod dim."""
    tokens = pc.split_pattern_regex(lines, r"[^\p{L}\p{N}]")
    owner = pc.list_parent_indices(tokens).to_numpy()
    place = np.arange(len(owner)) - tokens.offsets.to_numpy()[owner]
    known = pc.index_in(pc.list_flatten(tokens), value_set=pa.array(list(weights), lines.type)).fill_null(len(weights)).to_numpy()
    values = np.append(np.array(list(weights.values()), float), DEFAULT_WEIGHT)[known]
    made = np.bincount(owner * dim + place * STRIDE % dim, values, minlength=len(lines) * dim).reshape(-1, dim)
    size = np.sqrt((made**2).sum(axis=1, keepdims=True))
    return np.divide(made, size, out=np.zeros_like(made), where=size > 0)


def _text_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of texts, and where each text's begin; a last empty line counts as none, and so does an empty or null text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    cut = pc.split_pattern(pc.replace_substring_regex(texts, r"\n\z", ""), "\n")
    sizes = np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, np.diff(cut.offsets.to_numpy()))
    flat = pc.list_flatten(cut)
    keep = np.repeat(sizes > 0, np.diff(cut.offsets.to_numpy()))
    return flat.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(sizes)])


def embed(df: DataFrame, weights: dict[str, float] = TOKEN_WEIGHTS, text: str = "content", out: str = "embedding", dim: int = EMBEDDING_DIM) -> DataFrame:
    """Token-weight embedding of each text, in the text's own row (Arrow arrays, no shuffle): its line vectors with weight 1 + i/(2n),
    summed and made a unit vector. A null or empty text has the zero vector."""

    def vectors(texts: pa.Array) -> pa.Array:
        lines, starts = _text_lines(texts)
        sizes = np.diff(starts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        weight = 1.0 + 0.5 * (np.arange(len(owner)) - starts[owner]) / sizes[owner]
        total = np.zeros((len(sizes), dim))
        for at in range(0, len(lines), LINES):
            part = slice(at, at + LINES)
            np.add.at(total, owner[part], line_vectors(lines[part], weights, dim) * weight[part, None])
        size = np.sqrt((total**2).sum(axis=1, keepdims=True))
        total = np.divide(total, size, out=np.zeros_like(total), where=size > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * dim, pa.int32()), pa.array(total.reshape(-1)))

    vectors.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(vectors, "array<double>")(F.col(text)))


def nearest_lines(
    df: DataFrame, patterns: DataFrame, key: str, text: str = "content", threshold: float = 0.5, weights: dict[str, float] = TOKEN_WEIGHTS, dim: int = EMBEDDING_DIM
) -> DataFrame:
    """(key, pattern, line_no, similarity): for each text and pattern the line whose vector is closest to the pattern's, the first of equal
    ones, if its cosine is above the threshold. Blank lines and comments are not looked at.

    patterns: pattern, text. Their unit vectors go to every task, a bounded number at a time; a task multiplies blocks of lines with
    them and keeps the best line of each text and pattern, so nothing but results leaves the text's row."""
    found = df.sparkSession.createDataFrame([], f"{key} {df.schema[key].dataType.simpleString()}, pattern string, line_no int, similarity double")
    blocks = max(1, -(-patterns.count() // PATTERNS))
    for block in range(blocks):
        named = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).select(F.col("pattern").cast("string"), "text").collect()
        if not named:
            continue
        names = [r["pattern"] for r in named]
        sent = df.sparkSession.sparkContext.broadcast(line_vectors(pa.array([r["text"] or "" for r in named]), weights, dim).T)

        def best(batches, names=names, sent=sent):
            for batch in batches:
                lines, starts = _text_lines(batch.column(1))
                owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                trimmed = pc.utf8_trim_whitespace(lines)
                code = ~(pc.equal(trimmed, "").to_numpy(zero_copy_only=False) | pc.starts_with(trimmed, "//").to_numpy(zero_copy_only=False))
                top = np.full((batch.num_rows, len(names)), threshold)
                where = np.full((batch.num_rows, len(names)), -1)
                for at in range(0, len(lines), LINES):
                    part = np.flatnonzero(code[at : at + LINES]) + at
                    if not len(part):
                        continue
                    score = np.round(line_vectors(lines.take(pa.array(part)), weights, dim) @ sent.value, 12)
                    own = owner[part]
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    for a, b in zip(first, np.append(first[1:], len(part)), strict=True):
                        row, line = own[a], np.argmax(score[a:b], axis=0)
                        value = score[a:b][line, np.arange(len(names))]
                        more = value > top[row]
                        top[row, more], where[row, more] = value[more], part[a:b][line[more]] - starts[row] + 1
                row, kind = np.nonzero(where > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array([names[k] for k in kind], pa.string()), pa.array(where[row, kind], pa.int32()), pa.array(top[row, kind])],
                    [key, "pattern", "line_no", "similarity"],
                )

        found = found.unionByName(df.select(key, text).mapInArrow(best, found.schema))
    return found


#: Patterns per block of the nearest-pattern join.
BLOCK = 512
SALTS = 64


def nearest_patterns(vectors: DataFrame, patterns: DataFrame, key: str, vector: str = "embedding", threshold: float = 0.6) -> DataFrame:
    """Closest pattern of each vector by cosine, if above the threshold, with its severity.

    patterns: pattern, embedding. Patterns travel in packed blocks of a bounded size; a vector meets
    every block through an equi-join on the block number and a salt and keeps its best, so nothing is
    dropped however many patterns there are.
    """
    n_blocks = max(1, math.ceil(patterns.count() / BLOCK))
    packed = patterns.select(F.pmod(F.xxhash64("pattern"), F.lit(n_blocks)).cast("int").alias("_block"), F.struct("pattern", "embedding").alias("_p"))
    blocks = packed.groupBy("_block").agg(F.collect_list("_p").alias("_patterns"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    side = vectors.select(key, F.col(vector).alias("_v"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("_salt"))
    salted = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = side.withColumn("_block", numbers).join(salted, ["_block", "_salt"])
    best = F.array_max(F.transform("_patterns", lambda p: F.struct(cosine(F.col("_v"), p["embedding"]).alias("similarity"), p["pattern"].alias("pattern"))))
    top = met.select(key, best.alias("_best")).groupBy(key).agg(F.max("_best").alias("_best"))
    sim = F.col("_best.similarity")
    severity = F.when(sim > 0.85, "Critical").when(sim > 0.75, "High").otherwise("Medium")
    return top.filter(sim > threshold).select(key, F.col("_best.pattern").alias("pattern"), sim.alias("similarity"), severity.alias("severity"))


def centroids(vectors: DataFrame, by: str, vector: str = "embedding", dim: int = 64) -> DataFrame:
    """Mean vector per group, one sum per dimension so tasks combine before the shuffle."""
    v = F.col(vector)
    means = vectors.groupBy(by).agg(*[F.avg(v[i].cast("double")).alias(f"_{i}") for i in range(dim)])
    return means.select(F.col(by).cast("string").alias("pattern"), F.array(*[F.col(f"_{i}") for i in range(dim)]).alias("embedding"))


def wave_weights(dim: int) -> list[list[float]]:
    """Layer weights: a sine table scaled by the layer's width."""
    scale = math.sqrt(2.0 / (dim + dim))
    return [[max(-1.0, min(1.0, math.sin((i + j) * 0.1) * scale)) for j in range(dim)] for i in range(dim)]


def message_pass(nodes: DataFrame, edges: DataFrame, rounds: int = 2, node: str = "node", vector: str = "features", dim: int = 64) -> DataFrame:
    """Rounds of: sum of the in-neighbours plus twice the own vector, times the layer weights, ReLU. Edges and the state of
    every round are written once, so a round reads files and plans don't grow."""
    rows = ("array(" + ", ".join(f"{w!r}D" for w in row) + ")" for row in wave_weights(dim))
    matrix = F.expr("array(" + ", ".join(rows) + ")")
    state = nodes.select(node, F.col(vector).cast("array<double>").alias("_v"))
    e = write_cut(edges.select(F.col("src").alias(node), "dst").distinct())
    state = write_cut(state)
    cells = [f"_{i}" for i in range(dim)]
    for _ in range(rounds):
        own = state.select(node, *[(F.col("_v")[i] * 2).alias(c) for i, c in enumerate(cells)])
        near = state.join(e, node).select(F.col("dst").alias(node), *[F.col("_v")[i].alias(c) for i, c in enumerate(cells)])
        known = near.join(state.select(node), node, "left_semi")
        total = own.unionByName(known).groupBy(node).agg(*[F.sum(c).alias(c) for c in cells])
        summed = total.select(node, F.array(*cells).alias("_s"))
        layer = F.transform(matrix, lambda row: F.greatest(
            F.aggregate(F.zip_with(row, F.col("_s"), lambda w, x: w * x), F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0)))
        state = write_cut(summed.select(node, layer.alias("_v")))
    return state.select(node, F.col("_v").alias(vector))


ANOMALY = 0.7


def vector_deviation(vectors: DataFrame, node: str = "node", vector: str = "features", dim: int = 64, by: str | None = None) -> DataFrame:
    """RMS distance of each vector from the mean vector of its group (or of all)."""
    v = F.col(vector)
    group = F.col(by) if by else F.lit("all")
    keyed = vectors.withColumn("_g", group)
    mean = keyed.groupBy("_g").agg(*[F.avg(v[i]).alias(f"_{i}") for i in range(dim)])
    mean = mean.select("_g", F.array(*[F.col(f"_{i}") for i in range(dim)]).alias("_mean"))
    joined = keyed.join(mean if by else F.broadcast(mean), "_g")  # without groups: one row
    return joined.select(*vectors.columns, rms_deviation(v, F.col("_mean")).alias("deviation"))
