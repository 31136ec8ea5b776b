"""Fill-in-middle transformation of texts as a pipeline of Arrow kernels.

A batch of texts becomes list arrays of code points; the lists are flattened with their parent indices, a code point's ordinal in its
text says whether it is prefix, middle or suffix, the flat array is filtered by role, lists are rebuilt and joined, and the pieces
are put together with marks in the order of the row's form. Long texts pass in pieces, so the unit arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import CHUNK_BYTES, short_batches, table

# Marks of prefix, suffix and middle, and the pattern of any of them.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY_MARK = "<[PSM]>"

#: Of 100 texts, those that stay plain, and of the others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20

_MADE = (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string"))


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of each row, from the SHA-256 of seed and id; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _modulo(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _units(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(lists of code points, row of each list, ordinal of its first code point) of texts, about CHUNK_BYTES of text at a time; a
    longer text gives several lists. Rows ascend."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row, at, done = 0, int(bounds[0]), 0
    while row < len(texts):
        last = max(row, int(np.searchsorted(bounds, at + CHUNK_BYTES, side="right")) - 2)
        end = int(bounds[last + 1])
        if end - at > CHUNK_BYTES:
            end = at + CHUNK_BYTES
            while data[end] & 0xC0 == 0x80:
                end -= 1
        part = data[at:end]
        starts = np.flatnonzero(part & 0xC0 != 0x80)
        offsets = np.append(starts, len(part)).astype(np.int32)
        flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(part))
        edges = np.searchsorted(starts, np.clip(bounds[row : last + 2], at, end) - at)
        first = np.zeros(last + 1 - row, np.int64)
        first[0] = done
        yield pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat), np.arange(row, last + 1), first
        whole = end == bounds[last + 1]
        done = 0 if whole else done + len(starts)
        row, at = (last + 1 if whole else row), end


def _joined(pieces: list[pa.Array], rows: np.ndarray, n: int) -> pa.Array:
    """Pieces of each row, one after another."""
    offsets = np.searchsorted(rows, np.arange(n + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(pieces)), "")


def transform(texts: pa.Array, h: list[pa.Array]) -> list[pa.Array]:
    """Columns n, form, prefix_chars, middle_chars and output of texts (large strings without nulls) under the draws h."""
    n = pc.utf8_length(texts).cast(pa.int64())
    slots = pc.add(n, 1)
    one, two = _modulo(h[0], slots), _modulo(h[1], slots)
    low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    plain = pc.or_(pc.or_(pc.equal(n, 0), pc.match_substring_regex(texts, ANY_MARK)), pc.greater_equal(_modulo(h[2], 100), 100 - PLAIN))
    spm = pc.less(_modulo(h[3], 100), SUFFIX_FIRST)
    roles: list[list[pa.Array]] = [[], [], []]
    rows: list[np.ndarray] = []
    for lists, row, first in _units(texts):
        flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
        starts = pc.subtract(pa.array(first), lists.offsets[:-1].cast(pa.int64()))
        ordinals = pc.add(pa.array(np.arange(len(flat))), pc.take(starts, parents))
        owner = pc.take(pa.array(row), parents)
        before, after = pc.less(ordinals, pc.take(low, owner)), pc.greater_equal(ordinals, pc.take(high, owner))
        for role, mask in enumerate((before, pc.invert(pc.or_(before, after)), pc.and_(after, pc.invert(before)))):
            edges = np.searchsorted(pc.filter(parents, mask).to_numpy(), np.arange(len(lists) + 1))
            roles[role].append(pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pc.filter(flat, mask)), ""))
        rows.append(row)
    prefix, middle, suffix = (_joined(pieces, np.concatenate(rows), len(texts)) for pieces in roles)
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    swapped = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    output = pc.if_else(plain, texts.cast(pa.string()), pc.if_else(spm, swapped, psm))
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    empty = pa.scalar(None, pa.int64())
    return [n, form, pc.if_else(plain, empty, low), pc.if_else(plain, empty, pc.subtract(high, low)), output]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK_BYTES of text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at, base = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        yield at, to - at
        at, base = to, int(ends[to - 1])


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc, n, form, prefix_chars, middle_chars, output): each row of docs as a struct with its text rearranged.

    The text is cut at two drawn places into prefix, middle and suffix. Form psm is <P>prefix<S>suffix<M>middle, spm is
    <S>suffix<P>prefix<M>middle, plain is the text itself. Odd rows: a null text is an empty one; empty texts, and texts that hold a
    mark, are plain; parts may be empty; rows with equal ids draw alike, and a null id draws as an empty one; texts of any length
    are taken whole; other columns keep their values and names inside doc; an empty table gives no rows."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text", *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed))))

    out = StructType().add("doc", rows.schema["doc"].dataType)
    for name, kind in _MADE:
        out = out.add(name, kind)

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), pa.scalar("", pa.large_string()))
            for at, size in _slices(texts):
                made = transform(texts.slice(at, size), [batch.column(k).slice(at, size) for k in range(2, 6)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, size), *made], ["doc", *(name for name, _ in _MADE)])

    return rows.mapInArrow(run, out)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle has rearranged. A mark can only be one that was put in, since texts that hold one stay plain and
    no mark overlaps itself or another."""
    first, second, third = (F.get(F.split(output, ANY_MARK, -1), k) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select(
        "doc.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
cut AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": OP12_SQL}
