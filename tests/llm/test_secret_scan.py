import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.llm import secret_scan as ss

PLAIN = {
    "assign": (r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:w|W)(?:o|O)(?:r|R)(?:d|D)|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    "private": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda m: True),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", lambda m: len(m[0]) >= 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", lambda m: len(m[0]) >= 15),
    "url": (r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~-]+@", lambda m: True),
}


def plain_spans(text):
    found = [(m.start(), k, m.end()) for k, (regex, holds) in enumerate(PLAIN.values()) for m in re.finditer(regex, text) if holds(m)]
    return sorted(found)


def scan(texts, scanner=None):
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    found = dict((scanner or ss.scanner()).spans(data, bounds))
    return [found.get(k, []) for k in range(len(texts))]


PIECES = ["password", "PassWd", "secret", "token", "api_key", "apikey", "AKIA", "AKIA" + "Z9" * 8, "0123456789abcdef", "deadbeef" * 3, "f" * 23, "-----BEGIN ", "RSA PRIVATE KEY-----", "PRIVATE KEY",
          "ghp_", "a1" * 18, "xoxb-", "12-34-56-78", "://", "user:pa55@", "host", " ", "  ", "=", ":", '"', "'", "é", "😀", "\n", "a", "A", "-", "_", "K", "ſecret=abcdef", "abcdef", "abc"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=6), st.sampled_from([(1, 1), (3, 2), (2048, 24), (5, 1000)]))
def test_spans_match_plain_regexes(texts, sizes):
    before = ss.LANE_BYTES, ss.FEW_LANES
    ss.LANE_BYTES, ss.FEW_LANES = sizes
    try:
        assert scan(texts) == [plain_spans(t) for t in texts]
    finally:
        ss.LANE_BYTES, ss.FEW_LANES = before


def test_a_short_match_hides_what_it_covers():
    assert scan(["token=token:abcdefgh", "token==abcde", "token=abc token=abcdef"]) == [[], [(0, 0, 12)], [(10, 0, 22)]]
    assert scan(["secret" * 400 + "=" + "x" * 9])[0] == plain_spans("secret" * 400 + "=" + "x" * 9)


def test_long_texts_in_lanes():
    rng = random.Random(2)
    texts = ["".join(rng.choices(PIECES, k=20_000)), "f" * 300_000, "", "token = " + "q" * 100_000, ",".join(["token:abcdef"] * 9_000)]
    assert scan(texts) == [plain_spans(t) for t in texts]


@pytest.mark.parametrize("regex", ["ab*c", "(a|b)*abb", "a{3}", "a{2,}b?", "[a-c]+x|cc", r"\x61\+", "(ab|abc|c)+"])
def test_automata_are_minimal_and_equal_the_regex(regex):
    made = ss.determinise([(regex, False)], True)
    rng = random.Random(regex)
    for _ in range(400):
        text = "".join(rng.choices("abcx+", k=rng.randint(0, 8)))
        state = 0
        for b in text.encode():
            state = made.step[state, made.classes[b]]
        assert bool(made.accepts[state]) == bool(re.fullmatch(regex, text))
    # no two states with equal marks accept the same continuations of up to so many bytes as there are states
    block = made.accepts * 4 + made.idle
    for _ in range(len(block)):
        block = np.unique(np.column_stack([block, block[made.step]]), axis=0, return_inverse=True)[1].reshape(-1)
    assert len(set(block.tolist())) == len(block)


def test_rules_that_match_nothing_or_need_too_many_states_are_refused(monkeypatch):
    with pytest.raises(ValueError, match="nothing"):
        ss.determinise([("a*", False)], False)
    monkeypatch.setattr(ss, "MOST_STATES", 8)
    with pytest.raises(ValueError, match="states"):
        ss.determinise([("a{20}", False)], False)


def test_spans_match_sql(same_as_sql):
    same_as_sql(ss, "op13_secret_scan")


def test_secrets_in_tables_match_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(9)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    want = sorted(con.sql(ss.OP13_SQL).select(*names).fetchall())
    got = sorted(tuple(r) for r in ss.op13_secret_scan(spark, str(tmp_path)).select(*names).collect())
    assert got == want and sum(r[1] for r in got) and sum(r[2] for r in got) and sum(r[3] for r in got)


def test_odd_and_empty_tables(odd_docs, no_docs, spark):
    docs = odd_docs.withColumn("spans", F.lit("mine")).withColumn("text", F.concat("text", F.lit(" token=abcdef")))
    got = ss.scan_secrets(docs).collect()
    assert len(got) == 6 and all(r["doc"]["spans"] == "mine" for r in got)
    for r in got:
        text = r["doc"]["text"] or ""
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"]] == [(a, "assign", b) for a, _, b in plain_spans(text)]
    assert ss.scan_secrets(no_docs).count() == 0
