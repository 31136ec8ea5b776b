"""Line dedup: documents probe compact arrays behind minimal perfect hashes instead of joining lines.

Distinct line hashes that several documents hold are dealt into shards. Each shard keeps a minimal perfect hash (levels of bit
arrays; a key sits at its rank in the first level in which it met no other) over arrays of fingerprints, document counts and
owners. The lines that most documents hold form the first tier, whose arrays have a fixed greatest size and go to every task.
Only if more lines repeat than that tier holds, the others are probed shard by shard: hashes of lines that the first tier doesn't hold
travel to the shards, texts do not.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import SPACES, mix, table, write_cut

#: Shortest key, in code points, that is looked at.
LEAST_KEY = 10
#: Keys in the first tier (about 24 bytes each), keys of a shard, and probes that meet in a shard.
TIER_KEYS, SHARD_KEYS, SHARD_PROBES = 2_000_000, 200_000, 1_000_000
#: Stands for a null document id, after all others.
NO_ID = (1 << 63) - 1

_STRIP = SPACES.encode()
_BITS_PER_KEY, _LEVELS = 1.5, 32


# ---------------------------------------------------------------- minimal perfect hash over a shard


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)


def build_shard(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> dict:
    """Arrays of one shard for distinct (hi, lo) line hashes. Keys that no level separates (equal hi) go to a short list."""
    keys, levels, place, used = hi, [], np.full(len(hi), -1, np.int64), 0
    left = np.arange(len(hi))
    while len(left) and len(levels) < _LEVELS:
        size = max(64, -(-int(len(left) * _BITS_PER_KEY) // 64) * 64)
        at = _slot(keys[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        bits = np.packbits(alone, bitorder="little").view(np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        levels.append((size, bits, before[:-1].astype(np.int32), used))
        settled = alone[at]
        place[left[settled]] = used + np.cumsum(alone)[at[settled]] - 1
        used += int(before[-1])
        left = left[~settled]
    place[left] = np.arange(used, used + len(left))
    out = {"levels": levels, "rest": (hi[left], lo[left], place[left])}
    for name, values, kind in (("prints", lo, np.uint64), ("counts", counts, np.int64), ("owners", owners, np.int64)):
        out[name] = np.empty(len(hi), kind)
        out[name][place] = values
    return out


def probe_shard(shard: dict, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Index of each line hash in the shard's arrays, -1 where its fingerprint differs."""
    found = np.full(len(hi), -1, np.int64)
    left = np.arange(len(hi))
    for level, (size, bits, before, used) in enumerate(shard["levels"]):
        if not len(left):
            break
        at = _slot(hi[left], level, size)
        word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        rank = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        found[left[hit]] = used + before[at[hit] >> 6] + rank[hit]
        left = left[~hit]
    known = found >= 0
    found[known] = np.where(shard["prints"][found[known]] == lo[known], found[known], -1)
    for h, l, place in zip(*shard["rest"], strict=True):
        found[(hi == h) & (lo == l)] = place
    return found


# ---------------------------------------------------------------- lines


def line_key(line: bytes) -> bytes | None:
    """Stripped and lower-cased line, None if it is too short to count."""
    key = line.strip(_STRIP).lower()
    if len(key) >= 4 * LEAST_KEY or (len(key) >= LEAST_KEY and len(key.decode()) >= LEAST_KEY):
        return key
    return None


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _texts(ids: pa.Array, texts: pa.Array):
    """(document id, text as bytes) of each row."""
    return zip(ids.to_pylist(), (x.as_py() or b"" for x in texts.cast(pa.large_binary())), strict=True)


def _ids(docs: DataFrame) -> list[Column]:
    """doc and salt: the id, and for rows without one, which are told apart by their texts, a hash of the text."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc"), F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"])).otherwise(F.lit(0)).alias("salt")]


def _documents_lines(batches):
    """Each document's distinct line hashes."""
    for batch in batches:
        keys, owners = [], []
        for doc, text in _texts(batch.column(0), batch.column(1)):
            own = {k for k in map(line_key, text.split(b"\n")) if k is not None}
            keys.extend(own)
            owners.extend([doc] * len(own))
        if keys:
            hi, lo = _hashes(keys)
            yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(owners, pa.int64())], ["hi", "lo", "doc"])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(hi, lo, docs, owner): hashes of lines that at least two documents hold; owner is the smallest id."""
    lines = docs.select(_ids(docs)[0], "text").mapInArrow(_documents_lines, "hi long, lo long, doc long")
    held = lines.groupBy("hi", "lo").agg(F.min("doc").alias("owner"), F.max("doc").alias("top"), F.count(F.lit(1)).alias("docs"))
    return held.where("owner < top").select("hi", "lo", "docs", "owner")


def line_arrays(lines: DataFrame, shards: int) -> DataFrame:
    """(shard, arrays): one packed row for each shard of about SHARD_KEYS keys."""

    def build(rows: pa.Table) -> pa.Table:
        hi, lo, docs, owner = (rows.column(c).to_numpy() for c in ("hi", "lo", "docs", "owner"))
        packed = pickle.dumps(build_shard(hi.astype(np.int64).view(np.uint64), lo.astype(np.int64).view(np.uint64), docs, owner), protocol=5)
        return pa.table({"shard": rows.column("shard")[:1].cast(pa.int32()), "arrays": pa.array([packed], pa.binary())})

    dealt = lines.withColumn("shard", F.pmod("lo", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, arrays binary")


class FirstTier:
    """Arrays that each task holds."""

    def __init__(self, shards: int, packed: dict[int, bytes]):
        self.shards, self.packed, self._arrays = shards, packed, None

    def owners(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Smallest id that holds each line; NO_ID where the line isn't here."""
        if self._arrays is None:
            self._arrays = {k: pickle.loads(v) for k, v in self.packed.items()}
        out = np.full(len(hi), NO_ID, np.int64)
        shard = (lo.view(np.int64) % np.int64(self.shards)).astype(np.int64)
        for k, arrays in self._arrays.items():
            mine = np.flatnonzero(shard == k)
            if len(mine):
                found = probe_shard(arrays, hi[mine], lo[mine])
                out[mine[found >= 0]] = arrays["owners"][found[found >= 0]]
        return out

    def __getstate__(self):
        return self.__dict__ | {"_arrays": None}


def _least_count(lines: DataFrame, keys: int) -> int:
    """Fewest documents (a power of two) that hold a line of the first tier, so that the tier has at most so many keys."""
    found, least, have = {r["bits"]: r["count"] for r in lines.groupBy(F.length(F.bin("docs")).alias("bits")).count().collect()}, 1 << 62, 0
    for bits in sorted(found, reverse=True):
        have += found[bits]
        if have > keys:
            return least
        least = 1 << (bits - 1)
    return 0


def _routed_drops(docs: DataFrame, lines: DataFrame, tier) -> DataFrame:
    """(doc, salt, hashes): for each document the hashes of lines beyond the first tier that it must lose. Lines that the tier holds
    are not asked for, so no line that travels is held by more documents than any in the tier."""

    def ask(batches):
        for batch in batches:
            keys, rows = [], []
            for row, (_, text) in enumerate(_texts(batch.column(0), batch.column(1))):
                own = {k for k in map(line_key, text.split(b"\n")) if k is not None}
                keys.extend(own)
                rows.extend([row] * len(own))
            if keys:
                hi, lo = _hashes(keys)
                left = tier.value.owners(hi, lo) == NO_ID
                at = pa.array(np.asarray(rows, np.int64)[left])
                yield pa.RecordBatch.from_arrays([pa.array(hi[left].view(np.int64)), pa.array(lo[left].view(np.int64)), batch.column(0).take(at), batch.column(2).take(at)], ["hi", "lo", "doc", "salt"])

    doc, salt = _ids(docs)
    probes = write_cut(docs.select(doc, "text", salt).mapInArrow(ask, "hi long, lo long, doc long, salt long"))
    shards = max(1, -(-lines.count() // SHARD_KEYS), -(-probes.count() // SHARD_PROBES))
    arrays = line_arrays(lines, shards)

    def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
        hi, lo, doc = (asked.column(c).to_numpy() for c in ("hi", "lo", "doc"))
        lose = np.zeros(len(hi), bool)
        for packed in held.column("arrays").to_pylist():
            shard = pickle.loads(packed)
            found = probe_shard(shard, hi.astype(np.int64).view(np.uint64), lo.astype(np.int64).view(np.uint64))
            lose |= (found >= 0) & (shard["owners"][np.maximum(found, 0)] < doc)
        lost = asked.filter(pa.array(lose))
        return pa.table({"doc": lost.column("doc"), "salt": lost.column("salt"), "hash": lost.column("hi")})

    dealt = probes.withColumn("shard", F.pmod("lo", F.lit(shards)).cast("int")).repartition(shards, "shard").groupBy("shard")
    lost = dealt.cogroup(arrays.repartition(shards, "shard").groupBy("shard")).applyInArrow(probe, "doc long, salt long, hash long")
    return lost.groupBy("doc", "salt").agg(F.collect_set("hash").alias("lost"))


def dedup_lines(docs: DataFrame, tier_keys: int = TIER_KEYS) -> DataFrame:
    """docs with new columns __kept (text without the lost lines), __n_lines and __n_dropped, which replace any of these names; other
    columns pass through.

    A line's key is the line stripped of white space and ASCII lower-cased; a key of at least ten code points held by two or more
    ids stays only in the documents with the smallest id. Odd rows: a null or empty text is one empty line; repeated rows of one
    id count as one document; a null id counts as the greatest; texts of any length are taken whole; an empty table stays
    empty. A document may lose all its lines: its row stays with an empty text."""
    spark = docs.sparkSession
    docs = docs.drop("__kept", "__n_lines", "__n_dropped")
    lines = write_cut(repeated_lines(docs))
    least = _least_count(lines, tier_keys)
    first = lines.where(F.col("docs") >= least)
    shards = max(1, -(-first.count() // SHARD_KEYS))
    tier = FirstTier(shards, {r["shard"]: bytes(r["arrays"]) for r in line_arrays(first, shards).collect()})
    sent = spark.sparkContext.broadcast(tier)
    doc, salt = _ids(docs)
    place = docs.columns.index("text")
    rows = docs.select(doc, salt, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    if least > 0:
        rows = rows.join(_routed_drops(docs, lines.where(F.col("docs") < least), sent), ["doc", "salt"], "left")
    else:
        rows = rows.withColumn("lost", F.lit(None).cast("array<long>"))
    out = StructType().add("row", rows.schema["row"].dataType).add("__kept", "string").add("__n_lines", "long").add("__n_dropped", "long")

    def drop(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            extra = batch.column(2).to_pylist()
            docs_lines, keys, owners = [], [], []
            for doc, text in _texts(batch.column(0), pc.struct_field(batch.column(1), [place])):
                parts = text.split(b"\n")
                own = [(n, k) for n, k in enumerate(map(line_key, parts)) if k is not None]
                docs_lines.append((doc, parts, [n for n, _ in own]))
                keys.extend(k for _, k in own)
                owners.extend([doc] * len(own))
            hi, lo = _hashes(keys)
            lose = sent.value.owners(hi, lo) < np.asarray(owners, np.int64) if keys else np.zeros(0, bool)
            kept, total, dropped, at = [], [], [], 0
            for (_, parts, places), more in zip(docs_lines, extra, strict=True):
                mine = lose[at : at + len(places)]
                if more:
                    mine = mine | np.isin(hi[at : at + len(places)].view(np.int64), np.asarray(more, np.int64))
                at += len(places)
                total.append(len(parts))
                gone = {places[k] for k in np.flatnonzero(mine)}
                dropped.append(len(gone))
                kept.append(b"\n".join(p for n, p in enumerate(parts) if n not in gone) if gone else b"\n".join(parts))
            columns = [batch.column(1), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, out.fieldNames())

    return rows.select("doc", "row", "lost").mapInArrow(drop, out).select("row.*", "__kept", "__n_lines", "__n_dropped")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, i, s[i] AS line, translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), LATERAL (SELECT unnest(generate_series(1, len(s))) AS i)),
held AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.*, h.owner IS NOT NULL AND h.owner <> l.doc_id AS lost FROM lines l LEFT JOIN held h ON l.k = h.k AND length(l.k) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES = {"op5_line_dedup": OP5_SQL}
