import random

from auditlake.llm import quality_classifier, quality_rules, toxicity
from llm_corpus import marked


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_classifier_learns_and_holds_out(spark):
    docs, labels = marked(spark, "quality")
    rows = quality_classifier.classify(docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert auc([(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"]]) > 0.95
    again = quality_classifier.classify(docs.repartition(7), labels).collect()
    assert {(r["doc_id"], r["score"]) for r in rows} == {(r["doc_id"], r["score"]) for r in again}


def test_held_out_labels_are_not_learnt(spark):
    from pyspark.sql import functions as F

    docs, labels = marked(spark, "quality", 120)
    learnt = quality_classifier.learns(F.col("doc_id"), 5, 0)
    turned = labels.withColumn("quality", F.when(learnt, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (quality_classifier.train(docs, x) for x in (labels, turned))
    assert (a == b).all()


def test_toxicity_learns_words_and_stems(spark):
    docs, labels = marked(spark, "toxic")
    rows = toxicity.rate(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert auc([(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"]]) > 0.9


def test_unseen_words_read_as_unseen(spark):
    """Words whose hashes share their last bits have nothing to do with each other."""
    import numpy as np

    names = [f"{k:06x}z" for k in range(6000)]
    data = np.frombuffer(" ".join(names).encode(), np.uint8)
    spots = toxicity.Words(data, np.array([0, len(data)])).hashes(toxicity.LOWER) % np.uint64(1 << 21)
    seen, pair = {}, None
    for name, spot in zip(names, spots, strict=True):
        if spot in seen and seen[spot][:4] != name[:4]:
            pair = seen[spot], name
            break
        seen.setdefault(spot, name)
    learnt, asked = pair
    docs, labels = marked(spark, "toxic", 200)
    from pyspark.sql import functions as F

    docs = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, F.concat("text", F.lit(f" {learnt} {learnt} {learnt}"))).otherwise(F.col("text")).alias("text"))
    docs = docs.unionAll(spark.createDataFrame([(9000, asked + " ba"), (9001, "qqqqqqq ba")], "doc_id long, text string"))
    got = {r["doc_id"]: r["score"] for r in toxicity.rate(docs, labels).where("doc_id >= 9000").collect()}
    assert got[9000] == got[9001]


def test_toxicity_counts_match_plain_counts(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    docs, labels = marked(spark, "toxic", 120)
    labelled = docs.join(labels, "doc_id").select("text", F.col("toxic").alias("__label"), (F.col("doc_id") % 2).cast("int").alias("__fold"))
    rows = [(w.rstrip(","), 2 * r["__fold"] + r["__label"]) for r in labelled.collect() for w in r["text"].lower().split()]
    counts = toxicity.Counts(labelled)
    plain = Counter(rows)
    want = sorted(tuple(plain[w, k] for k in range(4)) for w in {w for w, _ in rows})
    assert sorted(tuple(r[f"n{k}"] for k in range(4)) for r in counts.words.collect()) == want
    for cut, table in ((5, counts.stems), (4, counts.shorts)):
        kinds = {c: Counter(w[:cut] for w in {w for w, k in rows if k % 2 == c}) for c in (0, 1)}
        want = sorted((kinds[0][s], kinds[1][s]) for s in kinds[0] | kinds[1])
        assert sorted((r["k20"], r["k21"]) for r in table.collect()) == want


def test_joined_ratios_score_as_sent_ones(spark, odd_docs, monkeypatch):
    docs, labels = marked(spark, "toxic", 150)
    docs = docs.unionByName(odd_docs.select("doc_id", "text"))
    one = sorted(((r["doc_id"], r["score"]) for r in toxicity.rate(docs, labels).collect()), key=repr)
    monkeypatch.setattr(toxicity, "RATIO_ROWS", 0)
    two = sorted(((r["doc_id"], r["score"]) for r in toxicity.rate(docs, labels).collect()), key=repr)
    assert len(one) == len(two) and all(a == c and abs(b - d) < 1e-6 for (a, b), (c, d) in zip(one, two, strict=True))


def test_models_on_odd_and_empty_tables(spark, odd_docs, no_docs, labels):
    for rate, train, score in ((quality_classifier.classify, quality_classifier.train, quality_classifier.score), (toxicity.rate, None, None)):
        rows = rate(odd_docs, labels).collect()
        assert len(rows) == 6 and all(r["score"] is not None for r in rows)
        assert rate(no_docs, labels).count() == 0
        assert rate(odd_docs, labels.limit(0)).count() == 6
    scored = quality_classifier.score(odd_docs, quality_classifier.train(odd_docs, labels))
    assert scored.columns == [*odd_docs.columns, "__score"]


def test_quality_rules_match_sql(same_as_sql):
    same_as_sql(quality_rules, "op6_quality_rules")


def test_fences_follow_their_group(spark):
    rng = random.Random(2)
    plain = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)), "en", "plain", 0) for k in range(60)]
    marked_up = [(1000 + k, " ".join(f"#{rng.randrange(10**6)}" for _ in range(30)), "en", "tags", 0) for k in range(60)]
    odd = [(5000, " ".join(f"#{rng.randrange(10**6)}" for _ in range(30)), "en", "plain", 0)]
    docs = spark.createDataFrame(plain + marked_up + odd, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    assert kept == {k for k, *_ in plain + marked_up}


def test_sketches_merge(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    halves = [quality_rules.sketches(quality_rules.signals(quality_rules.base_counts(docs.where(f"doc_id % 2 = {k}")))) for k in (0, 1)]
    whole = quality_rules.sketches(quality_rules.signals(quality_rules.base_counts(docs)))
    merged = quality_rules.merge_sketches(*halves)
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_rules_on_odd_and_empty_tables(odd_docs, no_docs):
    assert quality_rules.judge(odd_docs).count() == 6 and quality_rules.judge(no_docs).count() == 0
