"""Shared by the llm operators: words, word hashes over Arrow batches, keyed lookups and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import session
from auditlake.session import shared_folder

__all__ = ["shared_folder", "write_cut"]

# The characters that separate words.
SPACES = " \t\n\x0b\f\r"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"

#: Rows of a lookup table up to which it is sent to every executor (a row is a key and a few numbers).
LOOKUP_ROWS = 50_000
#: Copies of a larger lookup table over which the rows of a hot key are dealt.
LOOKUP_SALTS = 16
#: Rows that pass to Python at once; texts and arrays of shingles make rows long.
BATCH_ROWS = 1_000
#: Bytes of text hashed at once.
CHUNK_BYTES = 1 << 19
#: Bytes up to which spans are hashed side by side.
LONG_SPAN = 256

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_JOIN = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D], np.uint64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """From now on the session passes at most BATCH_ROWS rows to Python at once. It stays so, because results are lazy."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def write_cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, in short batches."""
    short_batches(df.sparkSession)
    return session.write_cut(df)


# ---------------------------------------------------------------- column helpers


def words(text: Column) -> Column:
    """Words of a text as an array; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def learns(doc_id: Column, folds: int, held: int) -> Column:
    """True for rows whose labels may be learnt: crc32 of the id as text, modulo folds, is not held."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != held


def lookup(rows: DataFrame, small: DataFrame, keys: list[str], limit: int = LOOKUP_ROWS) -> DataFrame:
    """Left join that treats nulls in keys as equal. small has one row per key and is counted first: up to limit rows it is
    broadcast, beyond that it is copied LOOKUP_SALTS times and the rows of a key are dealt over the copies."""
    few = small.count() <= limit
    named = small.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in small.columns if c not in keys))
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if few:
        joined = rows.join(F.broadcast(named), match, "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_SALTS - 1)))
        salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(LOOKUP_SALTS)).cast("int"))
        copies = named.withColumn("__copy", salts)
        joined = salted.join(copies, [*match, F.col("__salt") == F.col("__copy")], "left").drop("__salt", "__copy")
    return joined.drop(*(f"__{k}" for k in keys))


def keep_ids(rows: DataFrame, ids: DataFrame, how: str = "left_semi", limit: int = 1_000_000) -> DataFrame:
    """Semi or anti join on the one column of ids. Up to limit ids (8 bytes each) are broadcast, so that texts stay where they
    are; beyond that Spark's shuffle join is used."""
    key = ids.columns[0]
    return rows.join(F.broadcast(ids) if ids.count() <= limit else ids, key, how)


# ---------------------------------------------------------------- word hashes over Arrow text columns

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_SAME = np.arange(256, dtype=np.uint8)
LOWER = _SAME.copy()
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def coded_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number of each data[start:end] among the distinct ones, and those, for ascending, disjoint spans."""
    size = len(data) + 1
    solid = np.cumsum(np.bincount(starts, minlength=size) - np.bincount(ends, minlength=size))[:-1] > 0
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
    found = flat.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def _lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Independent 64-bit hashes of each data[start:end]. Eight bytes at a time are finalised into the hash, for all spans at once; spans
    of more than LONG_SPAN bytes are hashed by xxh3."""
    sizes = (ends - starts).astype(np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = [mix(sizes * (_M1 if lane else _M2) + _SEEDS[lane]) for lane in range(lanes)]
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN))
    at, left = starts[live], sizes[live]
    while len(live):
        part = blocks[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * np.uint64(8))) - np.uint64(1)
        out[0][live] = mix(out[0][live] ^ part)
        if lanes > 1:
            out[1][live] = mix(out[1][live] * _JOIN + part)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - np.uint64(8)
    for k in np.flatnonzero(sizes > LONG_SPAN):
        both = np.frombuffer(xxhash.xxh3_128_digest(data[starts[k] : ends[k]].tobytes()), "<u8")
        for lane in range(lanes):
            out[lane][k] = both[lane]
    return out


def wide_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The halves of a 128-bit hash of each data[start:end]."""
    first, second = _lanes(data, starts, ends, 2)
    return first, second


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], the first half of the wide one."""
    return _lanes(data, starts, ends, 1)[0]


class Words:
    """Words of consecutive texts that lie one after another in data, the row r at data[bounds[r]:bounds[r + 1]]. outside is true for
    the bytes that separate words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, outside: np.ndarray = _IS_SPACE):
        space = outside[data]
        opens, closes = np.ones(len(data), bool), np.ones(len(data), bool)
        opens[1:], closes[:-1] = space[:-1], space[1:]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        opens[edges], closes[edges - 1] = True, True
        self.data, self.bounds = data, bounds
        self.starts = np.flatnonzero(opens & ~space)
        self.ends = np.flatnonzero(closes & ~space) + 1
        self.first = np.searchsorted(self.starts, bounds)  # of the first word of each row, and one more
        self.counts = np.diff(self.first)

    def _mapped(self, mapped: np.ndarray) -> np.ndarray:
        return self.data if mapped is _SAME else mapped[self.data]

    def coded(self, mapped: np.ndarray = _SAME) -> tuple[np.ndarray, list[bytes]]:
        return coded_spans(self._mapped(mapped), self.starts, self.ends)

    def wide_hashes(self, mapped: np.ndarray = _SAME) -> tuple[np.ndarray, np.ndarray]:
        return wide_hashes(self._mapped(mapped), self.starts, self.ends)

    def hashes(self, mapped: np.ndarray = _SAME) -> np.ndarray:
        return span_hashes(self._mapped(mapped), self.starts, self.ends)

    def owners(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()


def text_chunks(texts: pa.Array, outside: np.ndarray = _IS_SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of runs of rows of about CHUNK_BYTES; a longer text is a run of its own. A null
    text has no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, side="right")) - 1)
        to = min(to, len(texts))
        yield at, to, Words(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], outside)
        at = to


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive words from each place on; the last n - 1 places have none. Ignores where rows end. Windows are paired
    to windows of doubled width, finalised each time, so that no pattern of words cancels out."""
    size = max(len(hashes) - n + 1, 0)
    if not size:
        return np.zeros(0, np.uint64)
    span, width, acc, have = hashes, 1, None, 0
    while True:
        if n & width:
            part = span[have : have + size]
            acc = part if acc is None else mix(acc * _JOIN + part)
            have += width
        if have == n:
            return mix(acc + np.uint64(n))
        span = mix(span[:-width] * _JOIN + span[width:])
        width *= 2


def inside(words: Words, n: int) -> np.ndarray:
    """True at each place of grams(hashes, n) whose n words belong to one row."""
    size = max(len(words.starts) - n + 1, 0)
    left = np.repeat(words.first[1:], words.counts)[:size] - np.arange(size)
    return left >= n


def blank(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([], schema)


# ---------------------------------------------------------------- sums of arrays over all tasks


def sum_arrays(parts: DataFrame, blocks: int) -> DataFrame:
    """parts: (block int, counts binary) with zlib-packed int64 arrays, one row for each task and block. Sums them by block; the
    task that sums holds one array for each of its blocks however many parts arrive."""
    import zlib

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(packed), np.int64)
                sums[block] = sums[block] + counts if block in sums else counts
        for block, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], ["block", "counts"])

    return parts.repartition(min(blocks, 64), "block").mapInArrow(add, "block int, counts binary")


def pack_arrays(counts: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows for sum_arrays from a flat array whose length is a multiple of blocks; blocks of zeros are left out."""
    import zlib

    for block, part in enumerate(counts.astype(np.int64).reshape(blocks, -1)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "counts"])


def unpack_arrays(summed: DataFrame, blocks: int, size: int) -> np.ndarray:
    """The whole array on the driver: size int64 numbers, fixed by the caller's parameters and not by the data."""
    import zlib

    out = np.zeros((blocks, size // blocks), np.int64)
    for row in summed.collect():
        out[row["block"]] = np.frombuffer(zlib.decompress(bytes(row["counts"])), np.int64)
    return out.reshape(-1)


# ---------------------------------------------------------------- connected components


def components(links: DataFrame) -> DataFrame:
    """(id, component) from (a, b) links; component is the smallest id reachable. Large-star and small-star rounds: in each,
    neighbours are tied to the smallest id in sight, so a chain halves. Each round is written to the shared folder; the driver
    sees two numbers a round. A hub's rows are spread: minima are summed before the shuffle and joined back skew-aware."""
    edges = write_cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = write_cut(small.where("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = tuple(state)
