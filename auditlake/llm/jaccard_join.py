"""N-gram Jaccard join: links between texts whose shingle sets overlap enough, and the groups they form.

Rows are numbered, and rows with equal sets are folded into one representative row first, which stands for that set alone. Representatives meet in tiles: a tile is named by a few minima of
the set under fixed hash functions, and there are so many tiles for each set that two sets at the threshold share none with a
chance below LOSS. Inside a tile only sets of the same or a neighbouring size band can link. Hashed parity bitmaps give a lower bound of the symmetric difference, so bit counts bound the overlap from above; only pairs that
pass meet in an exact intersection of sorted arrays.

Groups of copies do not become pairs. First every member of a tile and band is compared with one pivot alone, and the links found
are joined to components. A tile whose members are all in one component is finished; only pairs across components go on, in
blocks of bounded size. While a tile holds many components, a loose group, its members are compared with further pivots before that,
each of which joins a share of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import LOWER, Words, components, grams, keep_ids, mix, table, text_chunks, write_cut

#: Minima that name a tile, and the chance with which two sets at the threshold may miss each other.
MINIMA, LOSS = 4, 1e-12
#: Members of a tile compared in one block, and bits of a bitmap for each shingle.
BLOCK, BITS_EACH = 1024, 4
#: Components in a tile above which its members are compared with one more pivot first, most such rounds, and the part of the members
#: (one in so many) that must link for another round.
MANY, ROUNDS, SHARE = 64, 6, 16

_SEED = np.uint64(0x5851F42D4C957F2D)


def n_tiles(num: int, den: int) -> int:
    """Tiles of each set for a threshold of num / den."""
    return math.ceil(math.log(LOSS) / math.log(1 - (num / den) ** MINIMA))


def _functions(tiles: int) -> tuple[np.ndarray, np.ndarray]:
    raw = mix(np.arange(1, 2 * tiles * MINIMA + 1, dtype=np.uint64) * _SEED)
    return (raw[::2] >> np.uint64(32)).astype(np.uint32), (raw[1::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer than n words is one shingle, without words none."""
    hashes = words.hashes(LOWER)
    every = grams(hashes, n)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            out.append(mix(grams(hashes[a:b], b - a) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def tile_names(shingles: np.ndarray, xors: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Names of the tiles of one set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(xors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(least, ((short[at : at + 2048, None] ^ xors) * odds).min(axis=0), out=least)
    parts = least.reshape(-1, MINIMA).astype(np.uint64)
    acc = np.arange(len(parts), dtype=np.uint64)
    for k in range(MINIMA):
        acc = mix(acc * _SEED + parts[:, k])
    return acc


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap: a bit is set if an odd number of shingles fall on it; BITS_EACH times as many bits as shingles, rounded up to a
    power of two, 64 at least, so that few shingles cancel out and sets a little below the threshold are told apart. Halving a
    bitmap by exclusive or gives the one of half the width."""
    width = max(64, BITS_EACH << (len(shingles) - 1).bit_length())
    spots = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(spots.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_link(size_a, size_b, differing, num: int, den: int):
    """Whether sets of these sizes whose bitmaps differ in so many bits can reach the threshold: the overlap is at most half of
    (sizes - differing bits)."""
    total = size_a + size_b
    return (num + den) * (total - differing) >= 2 * num * total


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


# ---------------------------------------------------------------- stages


def _sketches(docs: DataFrame, n: int, tiles: int) -> DataFrame:
    """(row, doc, n, hi, lo, tiles, bits) of every row of docs (row, doc_id, text)."""
    xors, odds = _functions(tiles)

    def run(batches):
        for batch in batches:
            for low, high, words in text_chunks(batch.column(2)):
                sets = shingle_sets(words, n)
                hi = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                lo = [int(mix(s ^ _SEED).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                names = [tile_names(s, xors, odds).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in names])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(names), pa.int64())),
                     pa.array([bitmap(s).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                    ["row", "doc", "n", "hi", "lo", "tiles", "bits"],
                )

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc long, n long, hi long, lo long, tiles array<long>, bits binary")


def _arrays(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, n, shingles) of the wanted rows."""
    rows = docs.select(F.col("row").alias("id"), "text")

    def run(batches):
        for batch in batches:
            for low, high, words in text_chunks(batch.column(1)):
                sets = shingle_sets(words, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "shingles"]
                )

    return keep_ids(rows, wanted).mapInArrow(run, "id long, n long, shingles binary").where("n > 0")


def _exact(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, by intersection of sorted arrays."""
    wanted = write_cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = write_cut(_arrays(docs, wanted, n))

    def check(batches):
        for batch in batches:
            a, b, sa, sb = (batch.column(k) for k in range(4))
            hit = []
            for x, y in zip(sa, sb, strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = overlap(p, q)
                hit.append(den * both >= num * (len(p) + len(q) - both))
            mask = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    sized = pairs.join(left, "a").join(right, "b").where((den * F.least("na", "nb") >= num * F.greatest("na", "nb")))
    return sized.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def _by_bits(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that sizes and bitmaps leave possible."""

    def check(batches):
        for batch in batches:
            a, b, na, nb, ba, bb = (batch.column(k) for k in range(6))
            hit = []
            for x, y, p, q in zip(na.to_pylist(), nb.to_pylist(), ba, bb, strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                words = min(len(p), len(q))
                hit.append(bool(may_link(x, y, int(np.bitwise_count(fold(p, words) ^ fold(q, words)).sum()), num, den)))
            mask = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    sized = pairs.join(left, "a").join(right, "b").where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(check, "a long, b long").distinct()


def _across(shared: DataFrame, sets: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Possible pairs of different components that share a tile in the same or a neighbouring size band. Tiles of one component
    drop out; the others are cut into blocks, and a pair is looked at in the one block pair that holds both members."""
    labelled = _labelled(shared, labels)
    tiles = F.explode(F.array(F.struct(F.col("band").alias("g"), F.lit(True).alias("own")), F.struct((F.col("band") + 1).alias("g"), F.lit(False).alias("own"))))
    rows = labelled.withColumn("t", tiles).select("tile", "t.g", "t.own", "rep", "n", "label")
    mixed = rows.groupBy("tile", "g").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("own").alias("any"), F.count(F.lit(1)).alias("members"))
    mixed = mixed.where((F.col("low") < F.col("high")) & F.col("any")).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).drop("low", "high", "any", "members")
    opened = rows.join(mixed, ["tile", "g"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    opened = opened.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    opened = opened.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    ready = opened.join(sets.select("rep", "bits"), "rep").select("tile", "g", "i", "j", "mine", "own", "rep", "n", "label", "bits")

    def compare(rows: pa.Table) -> pa.Table:
        size, rep, label = (rows.column(c).to_numpy() for c in ("n", "rep", "label"))
        order = np.argsort(size, kind="stable")
        size, rep, label = size[order], rep[order], label[order]
        own, mine = rows.column("own").to_numpy()[order], rows.column("mine").to_numpy()[order]
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        bits = rows.column("bits").to_pylist()
        bits = [np.frombuffer(bits[k], np.uint64) for k in order]
        width = np.array([len(x) for x in bits])
        folded = {w: np.stack([fold(x, w) if len(x) <= 2 * w else np.zeros(w, np.uint64) for x in bits if len(x) >= w]) for w in np.unique(width)}
        found_a, found_b = [], []
        for k in range(len(size)):
            last = int(np.searchsorted(size * num, size[k] * den, side="right"))
            near = np.arange(k + 1, last)
            near = near[(label[near] != label[k]) & (own[near] | own[k]) & ((mine[near] != mine[k]) | (i == j))]
            if not len(near):
                continue
            rows_of = folded[width[k]]
            skip = len(bits) - len(rows_of)  # sizes ascend, and so do widths
            differ = np.bitwise_count(rows_of[near - skip] ^ rows_of[k - skip]).sum(axis=1).astype(np.int64)
            near = near[may_link(size[near], size[k], differ, num, den)]
            found_a.append(np.full(len(near), rep[k]))
            found_b.append(rep[near])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return ready.groupBy("tile", "g", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    return shared.join(labels, shared["rep"] == labels["id"], "left").select("tile", "rep", "n", "band", F.coalesce("component", "rep").alias("label"))


def _more_pivots(shared: DataFrame, sets: DataFrame, links: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(links, components of them) after rounds in which members of tiles with many components meet one member of another component."""
    labels = components(links)
    for turn in range(ROUNDS):
        members = _labelled(shared, labels)
        crowds = write_cut(members.groupBy("tile", "band").agg(F.count_distinct("label").alias("k")).where(F.col("k") > MANY).select("tile", "band"))
        if not crowds.take(1):
            break
        shared = write_cut(members.join(crowds, ["tile", "band"]))
        lot = F.xxhash64("label", F.lit(turn))
        pivots = shared.groupBy("tile", "band").agg(F.min_by(F.struct(F.col("rep").alias("pivot"), F.col("label").alias("own")), F.struct(lot, "rep")).alias("p")).select("tile", "band", "p.*")
        star = write_cut(shared.join(pivots, ["tile", "band"]).where("label <> own").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct())
        found = write_cut(_exact(docs, write_cut(_by_bits(star, sets, num, den)), shingle, num, den))
        new = found.count()
        if not new:
            break
        links = links.unionByName(found)
        labels = components(links)
        if new * SHARE < star.count():
            break  # members that mostly don't link gain nothing from pivots
        shared = shared.drop("label")
    return links, labels


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for every row in column row; written, so that the keys stay."""
    return write_cut(docs.withColumn("row", F.monotonically_increasing_id()))


def _linked(docs: DataFrame, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From numbered docs: (row, doc, n, rep) of every row with shingles, the same columns of the others with a null rep, and the
    links (a, b) of representatives. Nothing but texts links."""
    tiles = n_tiles(num, den)
    sketches = write_cut(_sketches(docs, shingle, tiles))
    sets = sketches.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("row").alias("rep"), F.first("tiles").alias("tiles"), F.first("bits").alias("bits"))
    sets = write_cut(sets)
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int")
    posted = sets.select(F.explode("tiles").alias("tile"), "rep", "n", band.alias("band"))
    crowded = posted.groupBy("tile").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("tile")
    shared = write_cut(posted.join(crowded, "tile"))
    pivots = shared.groupBy("tile", "band").agg(F.min("rep").alias("pivot"))
    star = shared.join(pivots, ["tile", "band"]).where("pivot < rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    first = write_cut(_exact(docs, write_cut(_by_bits(star, sets, num, den)), shingle, num, den))
    first, labels = _more_pivots(shared, sets, first, docs, shingle, num, den)
    more = write_cut(_across(shared, sets, labels, num, den))
    second = write_cut(_exact(docs, more, shingle, num, den))
    groups = sketches.where("n > 0").select("row", "doc", "hi", "lo", "n").join(sets.select("hi", "lo", "n", "rep"), ["hi", "lo", "n"])
    blank = sketches.where("n = 0").select("row", "doc", "n", F.lit(None).cast("long").alias("rep"))
    return write_cut(groups.select("row", "doc", "n", "rep")), blank, first.unionByName(second)


def _best(groups: DataFrame, links: DataFrame, value: Column) -> DataFrame:
    """(rep, best): the smallest value of the rows of each representative's component."""
    least = groups.groupBy("rep").agg(F.min(value).alias("least"))
    labelled = write_cut(least.join(components(links), F.col("rep") == F.col("id"), "left").select("rep", F.coalesce("component", "rep").alias("component"), "least"))
    best = labelled.groupBy("component").agg(F.min("least").alias("best"))
    return labelled.join(best, "component").select("rep", "best")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: rows link if den * overlap >= num * union of their sets of word shingles,
    words cut at white space and ASCII lower-cased; component_id is the smallest doc_id reachable.

    Odd rows: null, empty and blank texts have no shingles and link with nothing; a text shorter than a shingle is one shingle;
    rows with one id are one document with several texts; each row with a null id is a document of its own after all others,
    and its component is null if it reaches no id, as that of a null id without a text; an empty table gives no rows; other columns
    are not read."""
    groups, blank, links = _linked(numbered(docs.select("doc_id", "text")), shingle, num, den)
    several = groups.where("doc IS NOT NULL").groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("doc", "a")
    same = groups.join(several, "doc").where("a < rep").select("a", F.col("rep").alias("b"))
    reached = write_cut(groups.join(_best(groups, links.unionByName(same), F.col("doc")), "rep").select("doc", "n", F.col("best").alias("component_id")))
    by_id = reached.groupBy(F.col("doc").alias("id")).agg(F.min("component_id").alias("low"))
    alone = blank.join(by_id, F.col("doc") == F.col("id"), "left").select("doc", "n", F.coalesce("low", "doc").alias("component_id"))
    return reached.unionByName(alone).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def copies(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(row) of the rows of numbered docs that go when one row of each group of linked texts stays: the one with the smallest
    doc_id, null ids last and equal ids by row. Rows without shingles stay."""
    groups, _, links = _linked(docs, shingle, num, den)
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "row")
    return groups.join(_best(groups, links, order), "rep").where("row <> best.row").select("row")


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), 4, 85, 100)


#: Plain form: every pair that shares a shingle is counted, and the smallest id spreads along the links.
OP4_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, w[i:i+3] AS s FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
coded AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM shingles),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM coded a JOIN coded b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.d)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM reach r WHERE r.d = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLES = {"op4_jaccard_join": OP4_SQL}
