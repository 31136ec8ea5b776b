"""Corpus pipeline: quality classifier, line dedup, near duplicates, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as docs of the next. All but
the last return the columns of docs. Null and empty texts pass every stage: they have the classifier's score of no words, one empty
line, no near duplicates, no weight in the mix (so copies as their source's whole part says) and one token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import jaccard_join, line_dedup, mixing, packing, quality_classifier
from auditlake.llm.common import keep_ids, table, write_cut


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the classifier's cut go."""
    weights = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, weights).where(F.col("__score") >= quality_classifier.CUT).drop("__score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document that loses all of them stays with an empty text."""
    done = line_dedup.dedup_lines(docs)
    changed = {"text": F.when(F.col("__n_dropped") > 0, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__n_dropped") > 0, F.length("__kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.withColumns(changed).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row with the smallest id stays, null ids last."""
    rows = jaccard_join.numbered(docs.select(F.struct(*docs.columns).alias("doc")))
    gone = jaccard_join.copies(rows.select("row", "doc.doc_id", "doc.text"), 5, 80, 100)
    return keep_ids(rows, write_cut(gone), "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every row."""
    return packing.packs(docs)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier's training cannot be said in SQL; tests/llm/test_pipeline.py compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = write_cut(stage(spark, docs, sf_dir))
    return docs
