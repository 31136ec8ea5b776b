import corpus_pipeline
from llm_corpus import marked
from pyspark.sql import functions as F

import __spark_entry__
from auditlake.llm import packing


def test_stages_keep_columns_and_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    _, labels = marked(spark, "quality", 100)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.write_cut(stage(spark, before, str(tmp_path)))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        if name == "jaccard_join":
            assert after.exceptAll(before).count() == 0
        if name == "line_dedup":
            assert after.count() == before.count() and after.where(F.length("text") != F.col("n_chars")).count() == 0
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).collect()
    assert len(last) == before.count()
    assert {r["doc_id"]: r["n_tokens"] for r in last} == {r["doc_id"]: r["n"] for r in before.select("doc_id", packing.tokens(F.col("text")).alias("n")).collect()}


def test_near_duplicate_stage_keeps_the_smallest_id(spark):
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(9, text, "en", "a", 1), (4, text + " more", "en", "a", 1), (2, None, None, None, 0), (3, "", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [2, 3, 4]


def test_near_duplicate_stage_leaves_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    rows = [(5, a), (6, b), (None, a), (None, b + " end"), (None, c), (None, c + " end"), (7, None), (None, None), (None, "")]
    rows += [(9, a + " more"), (9, " ".join(f"d{k}" for k in range(80)))]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], "doc_id long, text string, lang string, source string, row long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    left = sorted(((r["doc_id"], (r["text"] or "")[:1]) for r in left.collect()), key=repr)
    assert left == sorted([(5, "a"), (6, "b"), (None, "c"), (7, ""), (None, ""), (None, ""), (9, "d")], key=repr)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
