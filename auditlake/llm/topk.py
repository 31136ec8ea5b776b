"""Exact top-k search by inner product with cover trees over queries and data.

The top of the data's tree is a bounded set of centers chosen from a sample; every vector belongs to its nearest center, and the
vectors of a center are cut into chunks. A chunk keeps a cover tree of its own, and so does each block of queries. Blocks first
search the chunks of their own center; then each block visits the chunks whose covering radius leaves room for a score above
the worst kth score in the block. Inside a pair, both trees are walked together and pairs of nodes are pruned in the same way.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import table, write_cut

#: Results of a query, vectors sampled for centers, most centers, least vectors for each center.
TOP, SAMPLE, CENTERS, EACH = 20, 4_000, 256, 2_000
#: Least rows of a data chunk and of a query block; both grow so that there are at most PARTS of them.
CHUNK, BLOCK, PARTS = 8_192, 1_024, 10_000
#: Points of a leaf and children of a node.
DATA_LEAF, QUERY_LEAF, FAN = 256, 64, 16

_NONE = np.iinfo(np.int64).min


# ---------------------------------------------------------------- cover trees


class Node:
    """Center, covering radius (of all points below) and either points or children."""

    __slots__ = ("center", "radius", "norm", "points", "children")

    def __init__(self, center, radius, points, children):
        self.center, self.radius, self.points, self.children = center, radius, points, children
        self.norm = float(np.sqrt(center @ center))


def _distances(matrix: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = matrix - center
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def cover(matrix: np.ndarray, points: np.ndarray, leaf: int) -> Node:
    """Cover tree over rows points of matrix. Children are picked farthest first until they cover their points within half of the
    node's radius, or there are FAN of them."""
    own = matrix[points]
    center = own[0] if len(points) == 1 else own[int(np.argmin(_distances(own, own.mean(axis=0))))]
    away = _distances(own, center)
    radius = float(away.max())
    if len(points) <= leaf or radius == 0:
        return Node(center, radius, points, None)
    nearest, owner = away, np.zeros(len(points), np.int64)
    for child in range(1, FAN):
        far = int(np.argmax(nearest))
        if nearest[far] <= radius / 2:
            break
        gap = _distances(own, own[far])
        closer = gap < nearest
        owner[closer], nearest = child, np.where(closer, gap, nearest)
    groups = [points[owner == k] for k in range(int(owner.max()) + 1)]
    return Node(center, radius, None, [cover(matrix, g, leaf) for g in groups if len(g)])


def best_score(center_a, radius_a, norm_a, center_b, radius_b, norm_b):
    """Greatest inner product of points within the radii of two centers; a little is added for rounding."""
    top = center_a @ center_b + radius_a * norm_b + radius_b * norm_a + radius_a * radius_b
    return top + 1e-6 + 1e-9 * abs(top)


class Best:
    """The k best (score, id) of each query of a block, greater scores first, then smaller ids."""

    def __init__(self, kth: np.ndarray, k: int):
        self.k, self.kth = k, kth.copy()
        self.scores = np.full((len(kth), k), _NONE, np.int64)
        self.ids = np.full((len(kth), k), np.iinfo(np.int64).max, np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        wins = scores >= self.kth[rows, None]
        hit = wins.any(axis=1)
        if not hit.any():
            return
        rows, scores, wins = rows[hit], scores[hit], wins[hit]
        some = wins.any(axis=0)
        scores, ids = np.where(wins, scores, _NONE)[:, some], np.broadcast_to(ids[some], (len(rows), int(some.sum())))
        ids = np.where(scores == _NONE, np.iinfo(np.int64).max, ids)
        scores, ids = np.concatenate([self.scores[rows], scores], axis=1), np.concatenate([self.ids[rows], ids], axis=1)
        order = np.lexsort((ids, -np.maximum(scores, _NONE + 1)), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        self.kth[rows] = np.maximum(self.kth[rows], self.scores[rows, -1])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: through doubles while no sum can pass 2**53, else in 64-bit whole numbers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def search(block: dict, chunk: dict, kth: np.ndarray, k: int) -> Best:
    """Dual-tree walk, most promising node pairs first; a pair goes if its bound is below the worst kth score of its queries."""
    best = Best(kth, k)
    q, d = block["tree"], chunk["tree"]
    worst = {}

    def below(node: Node) -> np.ndarray:
        if id(node) not in worst:
            worst[id(node)] = node.points if node.points is not None else np.concatenate([below(c) for c in node.children])
        return worst[id(node)]

    def bound(a: Node, b: Node) -> float:
        return best_score(a.center, a.radius, a.norm, b.center, b.radius, b.norm)

    heap, turn = [(-bound(q, d), 0, q, d)], 0
    while heap:
        top, _, a, b = heapq.heappop(heap)
        if -top < best.kth[below(a)].min():
            continue
        if a.points is not None and b.points is not None:
            scores = _products(block["matrix"][a.points], chunk["matrix"][b.points])
            same = block["ids"][a.points][:, None] == chunk["ids"][b.points][None, :]
            best.offer(a.points, np.where(same, _NONE, scores), chunk["ids"][b.points])
            continue
        split_a = b.points is not None or (a.points is None and a.radius > b.radius)
        for child in a.children if split_a else b.children:
            turn += 1
            pair = (child, b) if split_a else (a, child)
            heapq.heappush(heap, (-bound(*pair), turn, *pair))
    return best


# ---------------------------------------------------------------- stages


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v) with v = floor(64 x) of each component; vectors that are null or hold a null or non-finite component, and rows
    without an id, are left out. Shorter vectors are filled with zeros to the longest."""
    kept = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull()
        & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    )
    width = kept.agg(F.max(F.size("x"))).first()[0] or 0
    whole = F.transform("x", lambda c: F.floor(64 * c).cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("v"))


def _centers(vectors: DataFrame, total: int) -> np.ndarray:
    """Centers picked farthest first from a hash sample of about SAMPLE vectors; one for each EACH vectors, CENTERS at most."""
    share = int((1 << 20) * min(1.0, SAMPLE / max(1, total)))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).orderBy("vec_id", "v").select("v").collect()
    points = np.array([r["v"] for r in sample] or [vectors.first()["v"]], float)
    wanted = min(CENTERS, max(1, total // EACH))
    chosen, away = [points.mean(axis=0)], None
    while len(chosen) < wanted:
        gap = _distances(points, chosen[-1])
        away = gap if away is None else np.minimum(away, gap)
        if away.max() == 0:
            break
        chosen.append(points[int(np.argmax(away))])
    return np.array(chosen)


def _assigned(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """vectors with their nearest center and a packed form."""
    sent = vectors.sparkSession.sparkContext.broadcast(centers)
    norms = (centers**2).sum(axis=1)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, centers.shape[1])
                home = np.argmin(norms - 2 * (flat.astype(float) @ sent.value.T), axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary()), pa.array(home)], ["vec_id", "v", "home"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v binary, home int")


def _trees(rows: DataFrame, size: int, leaf: int) -> DataFrame:
    """(part, home, center, radius, rows, packed): the rows of each center cut into parts of about size, each with its tree."""
    counts = rows.groupBy("home").count().withColumn("parts", F.ceil(F.col("count") / size).cast("int"))
    cut = rows.join(F.broadcast(counts.drop("count")), "home").withColumn("k", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        matrix = np.stack([np.frombuffer(x, np.int64) for x in rows.column("v").to_pylist()])
        tree = cover(matrix.astype(float), np.arange(len(matrix)), leaf)
        small = matrix.astype(np.int32) if len(matrix) and matrix.size and np.abs(matrix).max() < 2**31 else matrix
        packed = pickle.dumps({"ids": rows.column("vec_id").to_numpy(), "matrix": small, "tree": _plain(tree)}, protocol=5)
        home = rows.column("home")[0].as_py()
        return pa.table({
            "part": pa.array([home * (1 << 32) + rows.column("k")[0].as_py()], pa.int64()), "home": pa.array([home], pa.int32()), "center": pa.array([tree.center.tolist()], pa.list_(pa.float64())),
            "radius": pa.array([tree.radius]), "packed": pa.array([packed], pa.binary()),
        })

    return write_cut(cut.groupBy("home", "k").applyInArrow(build, "part long, home int, center array<double>, radius double, packed binary"))


def _plain(node: Node):
    return (node.center, node.radius, node.points, None if node.children is None else [_plain(c) for c in node.children])


def _load(packed: bytes) -> dict:
    def tree(x):
        return Node(x[0], x[1], x[2], None if x[3] is None else [tree(c) for c in x[3]])

    out = pickle.loads(packed)
    return out | {"tree": tree(out["tree"])}


def _visit(pairs: DataFrame, blocks: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(block, query_id, vec_id, score) of the k best in each pair (block, chunk, kth)."""

    def run(batches):
        for batch in batches:
            for block, kth, q, d in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                queries, chunk = _load(q), _load(d)
                least = np.full(len(queries["ids"]), _NONE, np.int64) if kth is None else np.frombuffer(kth, np.int64)
                best = search(queries, chunk, least, k)
                row, col = np.nonzero(best.scores != _NONE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), block), pa.int64()), pa.array(queries["ids"][row], pa.int64()), pa.array(best.ids[row, col], pa.int64()), pa.array(best.scores[row, col], pa.int64())],
                    ["block", "query_id", "vec_id", "score"],
                )

    named = blocks.select(F.col("part").alias("block"), F.col("packed").alias("q"))
    met = pairs.join(named, "block").join(chunks.select(F.col("part").alias("chunk"), F.col("packed").alias("d")), "chunk")
    dealt = met.select("block", "kth", "q", "d").repartition(max(1, min(pairs.count(), 100_000)))
    return dealt.mapInArrow(run, "block long, query_id long, vec_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, asked: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of (vec_id, embedding) where asked holds, the k greatest inner products with all
    rows of other ids, ties to the smaller id; all of them if there are fewer than k.

    Odd rows: see whole_vectors for vectors that take no part; a query id that occurs several times is asked once, with the least of
    its vectors; repeated candidates are each returned; other columns are not read; an empty table gives no rows."""
    spark = rows.sparkSession
    vectors = write_cut(whole_vectors(rows))
    queries = vectors.where(asked).groupBy("vec_id").agg(F.min("v").alias("v"))
    total, n_queries = vectors.count(), queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centers = _centers(vectors, total)
    chunks = _trees(_assigned(vectors, centers), max(CHUNK, total // PARTS), DATA_LEAF)
    blocks = _trees(_assigned(queries, centers), max(BLOCK, n_queries // PARTS), QUERY_LEAF)
    home = blocks.select(F.col("part").alias("block"), "home").join(chunks.select(F.col("part").alias("chunk"), "home"), "home")
    home = home.select("block", "chunk", F.lit(None).cast("binary").alias("kth"))
    first = write_cut(_best(_visit(write_cut(home), blocks, chunks, k), k))

    # what each block must beat, and the chunks that still can
    known = first.groupBy("block", "query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    known = known.select("block", F.struct("query_id", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(_NONE)).alias("kth")).alias("q"))
    lists = known.groupBy("block").agg(F.collect_list("q").alias("known"))  # one block's queries, whose number is bounded
    tops = [(r["part"], r["home"], r["center"], r["radius"]) for r in chunks.select("part", "home", "center", "radius").collect()]
    tree = spark.sparkContext.broadcast(tops)

    def choose(batches):
        for batch in batches:
            for block, packed, found in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                queries = _load(packed)
                have = {x["query_id"]: x["kth"] for x in found or ()}
                kth = np.array([have.get(int(i), _NONE) for i in queries["ids"]], np.int64)
                node, least = queries["tree"], int(kth.min())
                out = []
                for part, home_of, center, radius in tree.value:
                    center = np.asarray(center)
                    if home_of != block >> 32 and best_score(node.center, node.radius, node.norm, center, radius, float(np.sqrt(center @ center))) >= least:
                        out.append(part)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), pa.array(out, pa.int64()), pa.array([kth.tobytes()] * len(out), pa.binary())], ["block", "chunk", "kth"])

    ready = blocks.select(F.col("part").alias("block"), "packed").join(lists, "block", "left")
    pairs = write_cut(ready.select("block", "packed", "known").mapInArrow(choose, "block long, chunk long, kth binary"))
    every = first.drop("rank").unionByName(_visit(pairs, blocks, chunks, k))
    return _best(every, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x : floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.x, d.x)::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {"op10_topk": op10_topk}
ORACLES = {"op10_topk": OP10_SQL}
