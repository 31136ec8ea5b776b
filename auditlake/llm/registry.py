"""The registered queries of this subpackage and their SQL."""

from importlib import import_module

MODULES = ("mixing", "packing", "quality_classifier", "jaccard_join", "line_dedup", "quality_rules", "warc", "toxicity", "substring_dedup", "topk", "fill_in_middle", "secret_scan", "lexical_search")


def load():
    """(queries, oracles) of all modules and the pipeline."""
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"auditlake.llm.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    pipeline = import_module("corpus_pipeline")
    queries["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL:
        oracles["pipeline"] = pipeline.ORACLE_SQL
    return queries, oracles
