"""Checked queries over the fixture tables, grouped by operator family."""

from importlib import import_module

MODULES = ("finding_queries", "score_queries", "monitor_queries", "cfg_queries", "code_queries", "graph_queries", "stream_queries", "relation_queries")


def load():
    """(queries, oracles) of all modules."""
    from auditlake.catalog.base import ORACLES, QUERIES

    for name in MODULES:
        import_module(f"auditlake.catalog.{name}")
    return dict(QUERIES), dict(ORACLES)
