import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by scoring every document."""
    counted = [(d, terms(t)) for d, t in docs]
    counted = [(d, t) for d, t in counted if t]
    total, length = len(counted), sum(len(t) for _, t in counted)
    held = {}
    for _, t in counted:
        for x in set(t):
            held[x] = held.get(x, 0) + 1
    asked = {}
    for item, text in items:
        if terms(text):
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        found = []
        for d, t in counted:
            m = 10 + (90 * len(t) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * held[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in own if x in held)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, n, d, -s) for n, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def invented(seed, n_docs=200, n_items=20):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "Ça", "ZÜ", "日本", "x9"]
    pick = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=n))
    docs = [(rng.choice([k, k // 3, None]) if k % 5 == 0 else k, pick(rng.choice((0, 1, 3, 30, 300))).replace(" ", rng.choice([" ", "-", "_\n", "."]))) for k in range(n_docs)]
    docs += [docs[3]] * 12 + [(None, None), (5000, ""), (5001, "... --- !!"), (None, "w50 w51"), (5002, "w50 w51"), (5003, "W50, w51")]
    items = [(k, pick(rng.choice((1, 2, 8, 40)))) for k in range(n_items)] + [(3, "w59 w58"), (None, "w50"), (None, "W51"), (77, None), (78, "--"), (79, "unheard of"), (79, "unheard of")]
    return docs, items


DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_search_matches_sql(spark, tmp_path):
    import duckdb

    docs, items = invented(1)
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    names = ["item_id", "rank", "doc_id", "score"]
    want = sorted(con.sql(ls.OP11_SQL).select(*names).fetchall(), key=repr)
    assert sorted((tuple(r) for r in ls.op11_lexical_search(spark, str(tmp_path)).select(*names).collect()), key=repr) == want == plain_search(docs, items)


@pytest.mark.parametrize("seed", [2, 3])
def test_small_buckets_and_blocks_match_brute_force(spark, monkeypatch, seed):
    """Many tasks, buckets, seeds and blocks of items: pruning must lose nothing."""
    docs, items = invented(seed)
    for name, value in (("BUCKET", 16), ("TASK_ROWS", 50), ("SEEDS", 5), ("STEP", 1), ("ITEM_TERMS", 60)):
        monkeypatch.setattr(ls, name, value)
    monkeypatch.setattr(ls.item_blocks, "__defaults__", (60,))
    blocks = list(ls.item_blocks(spark.createDataFrame(items, ITEMS)))
    assert len(blocks) > 1 and sorted(repr(i) for b in blocks for i, _ in b) == sorted({repr(i) for i, t in items if terms(t)})
    got = ls.search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS), 7)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(docs, items, 7)


def test_pruned_rows_cannot_reach_the_floor():
    """Rows that a bucket leaves out score below the floor, and a high floor leaves few rows."""
    rng = np.random.default_rng(5)
    few = 0
    for _ in range(60):
        n, width = int(rng.integers(1, 300)), 40
        sizes = rng.integers(1, 12, n)
        codes = np.concatenate([np.sort(rng.choice(width, s, replace=False)) for s in sizes]).astype(np.int32)
        values = rng.integers(1, 10**6, len(codes))
        weight = rng.integers(0, 9000, width)
        items = ls.Items([np.sort(rng.choice(width, int(rng.integers(1, 15)), replace=False))], weight)
        row = np.repeat(np.arange(n), sizes)
        norm = np.sqrt(np.bincount(row, weight[codes] * values.astype(float) ** 2, minlength=n))
        bucket = ls.Bucket(np.arange(n), np.zeros(n, bool), norm, sizes, codes, values, items.root)
        marked = np.zeros(width, np.int64)
        marked[items.own[0]] = weight[items.own[0]]
        scores = np.bincount(row, (marked[codes] * values).astype(float), minlength=n).astype(np.int64)
        assert (bucket.exact(np.arange(n), marked) == scores).all()
        assert (items.norm[0] * norm * (1 + 1e-9) + 1e-3 >= scores).all()
        for floor in (0.0, float(np.sort(scores)[-1]), float(np.sort(scores)[n // 2])):
            rows = bucket.possible(items.root, items.own[0], floor)
            out = np.ones(n, bool)
            out[rows] = False
            assert (scores[out] < max(floor, 1)).all()
            few += floor > 0 and len(rows) <= (scores >= floor).sum() + 2
    assert few > 40


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one fourteen"), (1, "TWO")], ITEMS).withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted((tuple(r) for r in ls.search(odd_docs, items).collect()), key=repr)
    assert got == plain_search(rows, [(1, "one fourteen two")]) and len(got) == 4
    more = odd_docs.unionByName(odd_docs.limit(1).withColumn("text", F.lit("other words")))
    assert sorted((tuple(r) for r in ls.search(more, items).collect()), key=repr) == plain_search(rows + [(rows[0][0], "other words")], [(1, "one fourteen two")])
    assert ls.search(no_docs, items).count() == 0 and ls.search(odd_docs, items.limit(0)).count() == 0
    assert ls.search(odd_docs, spark.createDataFrame([(4, "absent")], ITEMS)).count() == 0
