import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.llm import fill_in_middle as fim


def plain_form(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_forms_match_sql(same_as_sql):
    rows = same_as_sql(fim, "op12_fill_in_middle")
    assert len({r[1] for r in rows}) == 3


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 19])
def test_pieces_of_any_size_match_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(fim, "CHUNK_BYTES", max(4, chunk))
    rng = random.Random(chunk)
    texts = ["".join(rng.choices("aé漢😀 \n<PSM>", k=rng.choice((0, 1, 2, 5, 40, 300)))) for _ in range(120)] + ["<", "<P", "<S<S", "P>", "\x00\x00"]
    ids = list(range(len(texts)))
    digests = [hashlib.sha256(f"1:{k}".encode()).hexdigest() for k in ids]
    h = [pa.array([int(d[8 * k : 8 * k + 8], 16) for d in digests], pa.int64()) for k in range(4)]
    got = []
    large = pa.array(["before", *texts], pa.large_string()).slice(1)  # an array that does not start at its buffer's start
    for at, size in fim._slices(large):
        columns = fim.transform(large.slice(at, size), [x.slice(at, size) for x in h])
        got += list(zip(*(c.to_pylist() for c in columns), strict=True))
    assert got == [plain_form(k, t) for k, t in zip(ids, texts, strict=True)]


def test_round_trip_of_hard_texts(spark):
    texts = ["<", "<P", "S>", "<S", "P><", "<<S", "a<M", "M>b", "$1\\1", "é" * 50, "\n\n", "x" * 2_000_000, "<P> is a mark", ""] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["back"] == r["doc"]["text"]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_form(r["doc"]["doc_id"], r["doc"]["text"])


def test_odd_and_empty_tables(odd_docs, no_docs, spark):
    docs = odd_docs.withColumn("output", F.lit("mine")).withColumn("form", F.lit("mine")).withColumn("h0", F.lit(1)).withColumn("a.b", F.lit(2))
    got = fim.fill_in_middle(docs).collect()
    assert len(got) == 6 and all(r["doc"]["output"] == "mine" and r["doc"]["a.b"] == 2 for r in got)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_form(r["doc"]["doc_id"], r["doc"]["text"])
    assert fim.fill_in_middle(no_docs).count() == 0
