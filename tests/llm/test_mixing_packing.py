import itertools
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.llm import mixing, packing


def test_mix_matches_sql(same_as_sql):
    rows = same_as_sql(mixing, "op1_mixing")  # doc_id, size, source_size, taken, target
    assert all(r[3] <= 3 * r[1] for r in rows)


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5), ("z", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a (5) and null (2) and z (5) are full; b (2) and c (1) share the rest
    assert got["a"] == 30 and got[None] == 15 and got["z"] == 0
    assert abs(got["b"] - 1970 * 2 / 3) < 1e-9 and abs(got["c"] - 1970 / 3) < 1e-9


def test_taken_words_come_near_targets(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 50), "hot" if k % 3 else f"s{k % 4}", 0) for k in range(3000)], "doc_id long, text string, source string, extra int")
    rows = mixing.mix(docs).select("source", "__mix.*").collect()
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in target)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in rows)


def test_mix_of_odd_and_empty_tables(odd_docs, no_docs):
    assert mixing.mix(odd_docs).count() == 6 and mixing.mix(no_docs).count() == 0
    assert mixing.mixed(odd_docs).columns == odd_docs.columns


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=7), st.integers(1, 4))
def test_bounds_pad_least(histogram, buckets):
    lengths = sorted(histogram)

    def padding(bounds):
        return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())

    best = min(padding((*c, lengths[-1])) for r in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
    bounds = packing.best_bounds(lengths, [histogram[x] for x in lengths], buckets)
    assert len(bounds) <= buckets and bounds[-1] == lengths[-1] and padding(bounds) == best


def test_bounds_of_long_texts_pad_least(spark):
    histogram = {257: 3, 259: 5, 301: 4, 517: 9, 519: 2, 1001: 6, 1003: 1, 4099: 2, 70001: 1}
    lengths = spark.createDataFrame([(x,) for x, n in histogram.items() for _ in range(n)], "tokens long")

    def padding(bounds):
        return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())

    bounds = packing.bucket_bounds(lengths, 5)
    assert set(bounds) <= set(histogram) and len(bounds) <= 5
    assert padding(bounds) == min(padding((*c, 70001)) for c in itertools.combinations(sorted(histogram)[:-1], 4))


def test_batches_hold_every_document_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = packing.packs(docs, buckets=4, budget=500, shard_rows=7).collect()
    assert len(rows) == docs.count() and len({(r["batch_id"], r["slot"]) for r in rows}) == len(rows)
    by = defaultdict(list)
    for r in rows:
        assert r["padding"] == r["bucket"] - r["n_tokens"] >= 0
        by[r["bucket"], r["batch_id"]].append(r["slot"])
    short = defaultdict(int)
    for (bucket, _), slots in by.items():
        room = max(1, 500 // bucket)
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= room
        short[bucket] += len(slots) < room
    assert max(short.values()) <= 1
    again = packing.packs(docs.repartition(5), buckets=4, budget=500, shard_rows=7).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}


def test_packing_of_odd_and_empty_tables(odd_docs, no_docs):
    packed = packing.pack(odd_docs)
    assert packed.count() == 6 and set(odd_docs.columns) < set(packed.columns)
    assert packing.packs(no_docs).count() == 0


def test_names_with_underscores_pass_through(spark, odd_docs):
    docs = odd_docs
    for name in ("__size", "__tokens", "__bound", "__copy", "__source", "__order", "doc", "bound", "b", "s"):
        docs = docs.withColumn(name, F.lit(name))
    for made in (mixing.mix(docs), packing.pack(docs), mixing.mixed(docs)):
        rows = made.collect()
        assert rows and all(r["__size"] == "__size" and r["__tokens"] == "__tokens" and r["doc"] == "doc" for r in rows)
