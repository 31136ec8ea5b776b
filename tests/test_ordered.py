"""Split windows give the same result as plain ones, also when one key holds most rows."""

import random

from pyspark.sql import functions as F

from auditlake.operators.ordered import fill_forward, global_rank, nearest_marks, running_total, with_previous


def skewed(spark, n=600, seed=3):
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.6 else rng.choice([None, *(f"k{k}" for k in range(8))]), i, rng.choice([None, "a", "b", "c"]), rng.randrange(50)) for i in range(n)]
    return spark.createDataFrame(data, "k string, pos long, v string, x long").repartition(5), data


def test_previous_matches_plain_window(spark, rows):
    df, _ = skewed(spark)
    split = with_previous(df, "k", ["pos"], ["v", "x"], F.floor(F.col("pos") / 37))
    plain = with_previous(df, "k", ["pos"], ["v", "x"])
    assert rows(split, "k", "pos", "prev") == rows(plain, "k", "pos", "prev")


def test_fill_forward_matches_plain_window(spark, rows):
    df, _ = skewed(spark)
    marked = df.withColumn("m", F.when(F.col("x") > 45, F.col("pos")))
    assert rows(fill_forward(marked, "k", ["pos"], "m", F.floor(F.col("pos") / 11)), "k", "pos", "filled") == rows(
        fill_forward(marked, "k", ["pos"], "m"), "k", "pos", "filled")


def test_running_total_matches_python(spark, rows):
    df, data = skewed(spark)
    total, expected = {}, []
    for k, pos, _, x in sorted(data, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + x
        expected.append((k, pos, total[k]))
    got = rows(running_total(df, "k", ["pos"], F.col("x"), F.floor(F.col("pos") / 50)), "k", "pos", "total")
    assert got == sorted(expected, key=repr)


def test_global_rank(spark):
    df, data = skewed(spark)
    out = global_rank(df, [F.desc("x"), F.asc("pos")])
    got = [r["pos"] for r in sorted(out.collect(), key=lambda r: r["rank"])]
    assert got == [r[1] for r in sorted(data, key=lambda r: (-r[3], r[1]))]
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, len(data) + 1))


def test_nearest_marks(spark, rows):
    df, data = skewed(spark, 300)
    out = nearest_marks(df, "k", "pos", F.col("v") == "a", 20)
    marks = {}
    for k, pos, v, _ in data:
        if v == "a":
            marks.setdefault(k, []).append(pos)
    expected = []
    for k, pos, _, _ in data:
        before = [m for m in marks.get(k, []) if pos - 20 <= m <= pos]
        after = [m for m in marks.get(k, []) if pos < m <= pos + 20]
        expected.append((k, pos, max(before, default=None), min(after, default=None)))
    assert rows(out, "k", "pos", "prev_mark", "next_mark") == sorted(expected, key=repr)
