"""Registered queries against their SQL. A few run always; AUDITLAKE_FULL=1 runs them all."""

import os

import duckdb
import pytest

from auditlake.catalog import load

FOLDER = os.environ.get("AUDITLAKE_DATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()
SAMPLE = ("plan_scoreboard", "cap_by_severity", "typosquats", "authority_changes", "near", "rules_defi", "call_edges", "dominators", "plan_guard")
NAMES = sorted(ORACLES) if os.environ.get("AUDITLAKE_FULL") else SAMPLE
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return round(v, 9) if isinstance(v, float) else v


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 200


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no fixture tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    place = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(cell(r[p]) for p in place) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(cell(v) for v in r) for r in df.select(*cols).collect()), key=repr) == want
