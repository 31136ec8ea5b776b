"""Substring dedup: passages of at least LENGTH words that also start in an earlier document are removed.

Levels of doubling length: a short window is posted first, and only where it repeats is a window of about twice the length looked
at, until the wanted length is reached or nothing repeats. Of the shortest windows only the smallest hash of each wanted window is
posted; equal windows choose equal ones, so nothing is lost. Between levels goes a bit array of slots that two documents hit: its size
is bounded, false hits only let more windows through to the next level, and the last level compares 96-bit hashes of whole windows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import Words, grams, inside, short_batches, table, text_chunks, write_cut

#: Words of a passage, fewest words of a level, bits a posted window and greatest bits of the slots between levels.
LENGTH, SHORTEST, BITS_EACH, MOST_BITS = 13, 4, 8, 1 << 30
#: Blocks in which slots travel, and bits that one task merges.
BLOCKS, TASK_BITS = 256, 1 << 22
#: Documents that lose something (two numbers each) up to which their ids are broadcast.
LOST_ROWS = 1_000_000
#: Stands for a null document id, after all others.
NO_ID = (1 << 63) - 1


def levels(length: int) -> list[int]:
    """Window lengths from the shortest to the wanted one; each is at most twice the one before."""
    out = [length]
    while out[0] > SHORTEST:
        out.insert(0, max(SHORTEST, -(-out[0] // 2)))
    return out


def _smallest(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of span consecutive values from each place on."""
    out, have = values, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _posted(words: Words, hashes: np.ndarray, short: int, long: int) -> np.ndarray:
    """For each window of long words (as grams(hashes, long)) the smallest hash of its windows of short words."""
    if len(hashes) < long:
        return np.zeros(0, np.uint64)
    return _smallest(grams(hashes, short), long - short + 1)


# ---------------------------------------------------------------- slots that two documents hit


def _pack(slots: np.ndarray) -> bytes:
    return zlib.compress(np.diff(slots, prepend=0).astype(np.uint32).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint32), dtype=np.int64)


def repeated_slots(docs: DataFrame, windows, bits: int) -> np.ndarray:
    """Bit array of the slots (hash modulo bits) hit by at least two rows of docs. windows(words) -> (row, hash) of posted windows.
    Every task sends its slots sorted, as differences; a task that merges holds two bit arrays of its blocks."""
    part = bits // BLOCKS

    def collect(batches):
        held = []
        for batch in batches:
            for _, _, words in text_chunks(batch.column(0)):
                rows, hashes = windows(words)
                slots = (hashes % np.uint64(bits)).astype(np.int64)
                # a row counts once for each slot
                order = np.lexsort((rows, slots))
                rows, slots = rows[order], slots[order]
                new = np.ones(len(slots), bool)
                new[1:] = (slots[1:] != slots[:-1]) | (rows[1:] != rows[:-1])
                held.append(slots[new].astype(np.uint32))
        slots = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
        kinds, counts = np.unique(slots, return_counts=True)
        edges = np.searchsorted(kinds, np.arange(BLOCKS + 1, dtype=np.int64) * part)
        for block in range(BLOCKS):
            a, b = edges[block], edges[block + 1]
            if b > a:
                own, many = kinds[a:b].astype(np.int64) - block * part, counts[a:b] > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([_pack(own[~many])], pa.binary()), pa.array([_pack(own[many])], pa.binary())], ["block", "once", "twice"]
                )

    def merge(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, once, twice in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if block not in seen:
                    seen[block] = (np.zeros(part, bool), np.zeros(part, bool))
                first, again = seen[block]
                once = _unpack(once)
                again[_unpack(twice)] = True
                again[once[first[once]]] = True
                first[once] = True
        for block, (first, again) in seen.items():
            bitmap = np.packbits(again, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(bitmap, 1)], pa.binary())], ["block", "bits"])

    parts = docs.select("text").mapInArrow(collect, "block int, once binary, twice binary")
    merged = parts.repartition(min(BLOCKS, max(1, bits // TASK_BITS)), "block").mapInArrow(merge, "block int, bits binary")
    out = np.zeros((BLOCKS, part // 8), np.uint8)
    for row in merged.toLocalIterator():
        out[row["block"]] = np.frombuffer(zlib.decompress(bytes(row["bits"])), np.uint8)
    return out.reshape(-1)


def _hit(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = hashes % np.uint64(len(bitmap) * 8)
    return (bitmap[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _candidates(words: Words, hashes: np.ndarray, steps: list[int], level: int, bits: np.ndarray | None) -> np.ndarray:
    """Places of the windows of steps[level] words whose first and last windows of the level before repeat, as far as bits, the array of
    that level, tells."""
    length = steps[level]
    whole = inside(words, length)
    if level:
        # of the first level only the smallest window of each of the second was posted
        found = _hit(bits, _posted(words, hashes, steps[0], steps[1]) if level == 1 else grams(hashes, steps[level - 1]))
        span = steps[max(1, level - 1)]
        whole &= found[: len(whole)] & found[length - span : length - span + len(whole)]
    return np.flatnonzero(whole)


def _bits(docs_words: int) -> int:
    return int(min(MOST_BITS, max(1 << 20, 1 << int(docs_words * BITS_EACH - 1).bit_length())))


def _keyed(docs: DataFrame) -> list[Column]:
    """doc and salt: the id, and for rows without one, which are told apart by their texts, a hash of the text."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc"), F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"])).otherwise(F.lit(0)).alias("salt")]


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, salt, hash): the windows of each document whose words also start in a document with a smaller id."""
    short_batches(docs.sparkSession)
    steps, sent = levels(length), None
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    for level in range(len(steps) - 1):
        if level == 0:
            def windows(words, short=steps[0], long=steps[1]):
                whole = inside(words, long)
                posted = _posted(words, words.hashes(), short, long)
                # neighbours mostly choose the same window
                whole[1:] &= (posted[1:] != posted[:-1]) | ~whole[:-1]
                return words.owners()[: len(whole)][whole], posted[whole]
        else:
            def windows(words, level=level, bits=sent):
                hashes = words.hashes()
                places = _candidates(words, hashes, steps, level, bits.value)
                return words.owners()[places], grams(hashes, steps[level])[places]
        bitmap = repeated_slots(docs, windows, _bits(total // 25))
        if sent is not None:
            sent.destroy()  # what a level lets through is in the next one's array
        if not bitmap.any():
            return spark.createDataFrame([], "doc long, salt long, hash long")
        sent = spark.sparkContext.broadcast(bitmap)

    def post(batches):
        for batch in batches:
            for low, _, words in text_chunks(batch.column(2)):
                first, second = words.wide_hashes()
                places = _candidates(words, first, steps, len(steps) - 1, None if sent is None else sent.value)
                rows, hashes, more = words.owners()[places], grams(first, length)[places], (grams(second, length)[places] >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((more, hashes, rows))
                rows, hashes, more = rows[order], hashes[order], more[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1])
                at = pa.array(low + rows[new])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes[new].view(np.int64)), pa.array(more[new].view(np.int32))], ["doc", "salt", "hash", "more"])

    held = docs.select(*_keyed(docs), "text").mapInArrow(post, "doc long, salt long, hash long, more int")  # made twice rather than kept: as many rows as repeated words
    owners = held.groupBy("hash", "more").agg(F.min("doc").alias("owner"), F.max("doc").alias("top")).where("owner < top").select("hash", "more", "owner")
    return held.join(owners, ["hash", "more"]).where("doc > owner").select("doc", "salt", "hash")


def dedup_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with new columns __kept (words that stay, joined by a space), __n_words and __n_removed, which replace any of these names;
    other columns pass through.

    A word goes if a window of length words that covers it also starts in a document with a smaller id; windows are judged on the
    texts as given. Odd rows: null, empty and short texts have no window and lose nothing; rows of one id don't count against each
    other; a null id counts as the greatest; windows are compared by 96 bits of hashes of their words; an empty table stays empty."""
    docs = docs.drop("__kept", "__n_words", "__n_removed")
    lost = write_cut(repeated_windows(docs, length).groupBy("doc", "salt").agg(F.collect_set("hash").alias("lost")))
    ids = lost.select("doc", "salt")
    ids = F.broadcast(ids) if lost.count() <= LOST_ROWS else ids  # so that texts stay where they are
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_keyed(docs))
    touched = rows.join(ids, ["doc", "salt"], "left_semi").join(lost, ["doc", "salt"]).select("row", "lost")
    others = rows.join(ids, ["doc", "salt"], "left_anti").select("row", F.lit(None).cast("array<long>").alias("lost"))
    at = docs.columns.index("text")
    out = StructType().add("row", rows.schema["row"].dataType).add("__kept", "string").add("__n_words", "long").add("__n_removed", "long")

    def remove(batches):
        for batch in batches:
            lost_of = batch.column(1)
            for low, high, words in text_chunks(pc.struct_field(batch.column(0), [at])):
                kept, removed = [], []
                gone = np.zeros(len(words.starts) + 1, np.int64)
                hashes = None
                for row in range(low, high):
                    mine = lost_of[row]
                    if mine.is_valid and len(mine):
                        hashes = words.hashes() if hashes is None else hashes
                        a, b = words.first[row - low], words.first[row - low + 1]
                        places = a + np.flatnonzero(np.isin(grams(hashes[a:b], length).view(np.int64), mine.values.to_numpy()))
                        np.add.at(gone, places, 1)
                        np.add.at(gone, places + length, -1)
                covered = np.cumsum(gone[:-1]) > 0
                raw = words.data.tobytes()
                for row in range(high - low):
                    a, b = words.first[row], words.first[row + 1]
                    if covered[a:b].any():
                        kept.append(b" ".join(raw[words.starts[k] : words.ends[k]] for k in np.flatnonzero(~covered[a:b]) + a))
                    else:
                        kept.append(b" ".join(raw[words.bounds[row] : words.bounds[row + 1]].split()))
                    removed.append(int(covered[a:b].sum()))
                columns = [batch.column(0).slice(low, high - low), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, out.fieldNames())

    return touched.unionByName(others).mapInArrow(remove, out).select("row.*", "__kept", "__n_words", "__n_removed")


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = dedup_passages(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, w[i:i+12] AS g FROM texts, LATERAL (SELECT unnest(generate_series(1, len(w) - 12)) AS i)),
later AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(generate_series(0, 12)) AS k)),
placed AS (SELECT doc_id, w[i] AS word, i FROM texts, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i)),
kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS t, count(g.i) AS n
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""

QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLES = {"op9_substring_dedup": OP9_SQL}
