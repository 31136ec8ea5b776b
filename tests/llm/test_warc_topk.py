import gzip

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.llm import topk, warc


def test_archives_match_sql(same_as_sql):
    rows = same_as_sql(warc, "op7_warc")
    assert {r[3] for r in rows} == {"response", "revisit"}


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [True, False])
def test_arc_records_are_read_by_declared_length(tmp_path, version, packed):
    bodies = [b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nhi\n\nthere", b"", b"no header\nhttp://fake 0.0.0.0 19990101000000 text/plain 5\n"]
    data = warc._arc_start(version, "t.arc") + b"".join(warc.arc_record(version, f"http://u/{k}", "1.2.3.4", "19991231235959", "text/html", b) for k, b in enumerate(bodies))
    path = tmp_path / ("t.arc.gz" if packed else "t.arc")
    path.write_bytes(gzip.compress(data[:100]) + gzip.compress(data[100:]) if packed else data)
    records = list(warc.read_arc(str(path)))
    assert [r.block for r in records[1:]] == bodies and [r.number for r in records] == [0, 1, 2, 3]
    assert records[1].http == (b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n", b"hi\n\nthere") and records[3].http[0] == b""
    assert ("Result-code" in records[1].more) == (version == 2)
    made = warc.warc_record(records[1], None, False)
    assert b"WARC-Type: response\r\n" in made and b"WARC-Date: 1999-12-31T23:59:59Z\r\n" in made and b"WARC-Target-URI: http://u/0\r\n" in made
    assert b"WARC-Type: resource\r\n" in warc.warc_record(records[3], None, False) and b"WARC-Type: warcinfo\r\n" in warc.warc_record(records[0], None, False)


def test_broken_archives_raise(tmp_path):
    whole = warc._arc_start(1, "t.arc") + warc.arc_record(1, "http://u", "-", "2000", "text/html", b"x" * 50)
    for name, data in (("short", whole[:-20]), ("fields", whole + b"http://u 2000 5\nabcde\n"), ("version", whole.replace(b"1 0 pages", b"7 0 pages"))):
        path = tmp_path / f"{name}.arc"
        path.write_bytes(data)
        with pytest.raises(ValueError, match={"short": "early", "fields": "record line", "version": "version"}[name]):
            list(warc.read_arc(str(path)))


def test_ids_of_revisits_point_at_responses(spark, folder, tmp_path):
    rows = warc.through_archives(spark.read.parquet(f"{folder}/pages.parquet"), str(tmp_path)).collect()
    by_id = {r["record_id"]: r for r in rows}
    assert len(by_id) == len(rows)
    for r in rows:
        if r["record_type"] == "revisit":
            first = by_id[r["refers_to_id"]]
            assert first["page_id"] == r["refers_to"] and first["payload_digest"] == r["payload_digest"] and first["record_type"] == "response"


def test_archives_of_odd_and_empty_tables(spark, tmp_path):
    body = "<p>" + "x" * 200
    rows = [(5, "u v\n", body)] * 2 + [(None, None, body), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("path", F.lit("p"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.through_archives(pages, str(tmp_path / "a")).collect()), key=repr)
    assert got == sorted([(5, 203, "response", None), (5, 203, "revisit", 5), (None, 203, "revisit", 5), (None, 0, "response", None)], key=repr)
    assert warc.through_archives(pages.limit(0), str(tmp_path / "b")).count() == 0


# ---------------------------------------------------------------- top k


def test_search_matches_sql(same_as_sql):
    same_as_sql(topk, "op10_topk")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 40), st.integers(1, 4), st.integers(1, 6), st.integers(0, 10**6))
def test_dual_tree_matches_brute_force(n, m, width, k, seed):
    rng = np.random.default_rng(seed)
    data, queries = rng.integers(-3, 4, (n, width)), rng.integers(-3, 4, (m, width))
    if seed % 3 == 0:
        data[: n // 2] = data[0]
    ids, asked = rng.permutation(1000)[:n], rng.permutation(1000)[:m]
    chunk = {"ids": ids, "matrix": data, "tree": topk.cover(data.astype(float), np.arange(n), 4)}
    block = {"ids": asked, "matrix": queries, "tree": topk.cover(queries.astype(float), np.arange(m), 3)}
    best = topk.search(block, chunk, np.full(m, topk._NONE, np.int64), k)
    for row in range(m):
        scores = queries[row] @ data.T
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != asked[row])[:k]
        got = [(-s, i) for s, i in zip(best.scores[row].tolist(), best.ids[row].tolist(), strict=True) if s != topk._NONE]
        assert got == want


def test_many_parts_give_the_same(spark, folder, monkeypatch):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    asked = F.col("vec_id") % 20 == 0
    want = sorted(map(tuple, topk.top_k(rows, asked, 7).collect()))
    for name, value in (("EACH", 10), ("CHUNK", 8), ("BLOCK", 2), ("DATA_LEAF", 2), ("QUERY_LEAF", 1)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(map(tuple, topk.top_k(rows.repartition(4), asked, 7).collect())) == want


def test_large_numbers_stay_exact():
    a = np.array([[2**31 - 1, 2**30], [1, -(2**31)]], np.int64)
    assert topk._products(a, a).tolist() == [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in a] for x in a]


def test_search_of_odd_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, score int, rank string"
    rows = [(0, [1.0, 2.0], 1, "x"), (0, [0.5], 1, "x"), (3, [1.0], 1, "x"), (3, [1.0], 1, "x"), (4, [], 1, "x"), (None, [1.0, 1.0], 1, "x"), (5, None, 1, "x"), (6, [None, 1.0], 1, "x")]
    got = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0).collect()
    # of the two rows of id 0 the smaller vector asks
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 3, 2048), (0, 2, 3, 2048), (0, 3, 4, 0)]
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0


def test_search_of_empty_vectors(spark):
    """Every score is 0, ties go to the smaller id."""
    rows = spark.createDataFrame([(k, []) for k in (0, 20, 21, 5)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(rows, F.col("vec_id") % 20 == 0, 2).collect())
    assert got == [(0, 1, 5, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 5, 0)]
