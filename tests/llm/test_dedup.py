import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import jaccard_join, line_dedup, substring_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- lines


def test_line_dedup_matches_sql(same_as_sql):
    assert any(r[2] for r in same_as_sql(line_dedup, "op5_line_dedup"))


def test_both_tiers_drop_the_same_lines(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    one, two = (sorted(map(tuple, line_dedup.dedup_lines(docs, tier).collect()), key=repr) for tier in (2_000_000, 1))
    assert one == two


def test_second_tier_with_a_hot_line_and_null_ids(spark, monkeypatch):
    """Half of all documents hold one line, which stays out of the shards; rows without an id are told apart by their texts."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    hot = "a line that half of all documents hold"
    rows = [(k if k % 5 else None, "\n".join([f"only here {k} and nowhere"] + [hot] * (k % 2) + [f"shared by two or three {k // 3}"])) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("__doc", "__lost", "__kept", "doc", "salt", "row", "shard", "a.b"):
        docs = docs.withColumn(name, F.lit(name))
    first = {}
    for doc, text in rows:
        for line in text.split("\n"):
            first.setdefault(line, set()).add(line_dedup.NO_ID if doc is None else doc)
    want = sorted(((doc, "\n".join(x for x in text.split("\n") if len(first[x]) < 2 or min(first[x]) == (line_dedup.NO_ID if doc is None else doc))) for doc, text in rows), key=repr)
    for tier in (1, 2_000_000):
        done = line_dedup.dedup_lines(docs, tier).collect()
        assert sorted(((r["doc_id"], r["__kept"]) for r in done), key=repr) == want
        assert all(r["__doc"] == "__doc" and r["row"] == "row" for r in done)


def test_perfect_hash_is_minimal_and_probes_exactly():
    rng = np.random.default_rng(4)
    hi, lo = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)
    hi[:3] = hi[0]  # no level can separate equal first halves
    shard = line_dedup.build_shard(hi, lo, np.arange(5000), np.arange(5000) * 2)
    found = line_dedup.probe_shard(shard, hi, lo)
    assert sorted(found) == list(range(5000)) and (shard["owners"][found] == np.arange(5000) * 2).all() and (shard["counts"][found] == np.arange(5000)).all()
    assert (line_dedup.probe_shard(shard, hi + np.uint64(1), lo + np.uint64(1)) == -1).all()
    assert line_dedup.build_shard(hi[:0], lo[:0], hi[:0], hi[:0])["owners"].size == 0


def test_line_keys():
    assert line_dedup.line_key(b"  ABCDEfghij\t") == b"abcdefghij" and line_dedup.line_key(b"abcdefghi") is None
    assert line_dedup.line_key("é".encode() * 9) is None and line_dedup.line_key("é".encode() * 10) is not None


def test_line_dedup_of_odd_and_empty_tables(odd_docs, no_docs):
    done = line_dedup.dedup_lines(odd_docs)
    assert done.columns[: len(odd_docs.columns)] == odd_docs.columns
    kept = sorted((r["doc_id"] is None, r["__n_lines"], r["__n_dropped"]) for r in done.collect())
    # repeated rows of the smallest id keep their line, the null id loses it
    assert kept == [(False, 1, 0)] * 4 + [(True, 1, 0), (True, 1, 1)]
    assert line_dedup.dedup_lines(no_docs).count() == 0


# ---------------------------------------------------------------- near duplicates


def test_jaccard_matches_sql(same_as_sql):
    rows = same_as_sql(jaccard_join, "op4_jaccard_join")
    assert any(component != doc for component, doc, _ in rows)


@pytest.mark.parametrize(("block", "many"), [(1024, 64), (3, 64), (1024, 2)])
def test_groups_match_brute_force(spark, monkeypatch, block, many):
    """A large loose group, whose members link only in chains, in blocks of different sizes and with further pivots."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "MANY", many)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for k in range(50):
        if k % 10 == 0:
            base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        base = list(base)
        base[rng.randrange(60)] = f"x{k}"
        docs.append((k * 7 % 50, " ".join(base)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(56)} for d, t in docs}
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and comp[a] > comp[b]:
                    comp[a] = comp[b]
                    changed = True
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80, 100)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == comp
    assert len(set(comp.values())) < 50


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 400)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 60)), dtype=np.uint64)]))
        if not len(b):
            continue
        x, y = jaccard_join.bitmap(a), jaccard_join.bitmap(b)
        least = min(len(x), len(y))
        differ = int(np.bitwise_count(jaccard_join.fold(x, least) ^ jaccard_join.fold(y, least)).sum())
        both = len(np.intersect1d(a, b))
        assert jaccard_join.overlap(a, b) == both and differ <= len(a) + len(b) - 2 * both
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert jaccard_join.may_link(len(a), len(b), differ, 85, 100)


def test_groups_of_odd_and_empty_tables(odd_docs, no_docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(odd_docs).collect()), key=repr)
    # a null id links through its own text; without one it links with nothing
    assert got == sorted([(1, 10, 1)] * 3 + [(2, 0, 2), (None, 10, 1), (None, 0, None)], key=repr)
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_empty_rows_without_an_id_link_with_nothing(spark):
    docs = spark.createDataFrame([(1, "w"), (None, "w"), (None, None), (None, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (None, 1, 1), (None, 0, None), (None, 0, None)], key=repr)


def alike():
    """Texts of two letters, and of two words, that follow the Thue-Morse sequence and its complement: polynomial sums are equal."""
    turns = [bin(k).count("1") % 2 for k in range(1024)]
    letters = ["".join("ab"[t ^ flip] for t in turns) for flip in (0, 1)]
    return letters, [" ".join(("left", "right")[t ^ flip] for t in turns[:16]) for flip in (0, 1)]


def test_words_that_polynomials_mix_up_stay_apart(spark):
    (a, b), (c, d) = alike()
    docs = spark.createDataFrame([(1, f"{a} {a} {a} {a}"), (2, f"{b} {b} {b} {b}"), (3, c), (4, d)], "doc_id long, text string")
    assert [r["component_id"] for r in jaccard_join.near_duplicates(docs, 16).orderBy("doc_id").collect()] == [1, 2, 3, 4]
    both = spark.createDataFrame([(1, " ".join([a] * 13)), (2, " ".join([b] * 13)), (3, c), (4, d)], "doc_id long, text string")
    for length in (13, 16):
        assert [r["__n_removed"] for r in substring_dedup.dedup_passages(both, length).orderBy("doc_id").collect()] == [0] * 4


def _prose(seed, size=60):
    return [f"{seed}{k}" for k in range(size)]


def test_null_ids_do_not_join_unrelated_documents(spark):
    a, b = " ".join(_prose("a")), " ".join(_prose("b"))
    docs = spark.createDataFrame([(1, a), (2, b), (None, a + " end"), (None, b), (None, " ".join(_prose("c")))], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 2), (None, 1), (None, 2), (None, None)], key=repr)


def test_two_texts_of_one_id_keep_their_links(spark):
    """Near copies of each text of an id, whose sets differ much in size."""
    docs = []
    for k in range(12):
        long, short = _prose(f"l{k}x", 400), _prose(f"s{k}x", 70)
        docs += [(100 * k + 50, " ".join(long)), (100 * k + 50, " ".join(short)), (100 * k + 60, " ".join(long[:-9])), (100 * k + 70, " ".join(short[1:])), (100 * k + 80, " ".join(short[:-1]))]
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert all(r["component_id"] == r["doc_id"] // 100 * 100 + 50 for r in got) and len(got) == 60


# ---------------------------------------------------------------- passages


def test_passages_match_sql(same_as_sql):
    assert any(r[2] for r in same_as_sql(substring_dedup, "op9_substring_dedup"))


@pytest.mark.parametrize("length", [3, 13, 25, 30])
def test_passages_of_any_length_match_brute_force(spark, folder, length):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    first = {}
    for d in sorted(rows):
        for i in range(len(rows[d]) - length + 1):
            first.setdefault(tuple(rows[d][i : i + length]), d)
    want = {}
    for d, w in rows.items():
        gone = {i + k for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < d for k in range(length)}
        want[d] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = substring_dedup.dedup_passages(docs, length)
    assert {r["doc_id"]: (r["__n_words"], r["__n_removed"], r["__kept"]) for r in got.collect()} == want


def test_levels_double():
    assert substring_dedup.levels(13) == [4, 7, 13] and substring_dedup.levels(3) == [3] and substring_dedup.levels(50) == [4, 7, 13, 25, 50]
    for length in range(1, 80):
        steps = substring_dedup.levels(length)
        assert all(a < b <= 2 * a for a, b in zip(steps, steps[1:])) and steps[-1] == length


def test_passages_of_null_ids_and_clashing_names(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(7, text), (None, text + " more"), (None, text + " more"), (None, "other " + text), (None, " ".join(f"x{k}" for k in range(20))), (None, " ".join(f"x{k}" for k in range(20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("__doc", "__lost", "__kept", "doc", "salt", "lost", "row", "hash", "a.b"):
        docs = docs.withColumn(name, F.lit(name))
    for most in (1_000_000, 0):
        monkeypatch.setattr(substring_dedup, "LOST_ROWS", most)
        done = substring_dedup.dedup_passages(docs)
        got = sorted(((r["doc_id"], r["__kept"], r["__n_removed"]) for r in done.collect()), key=repr)
        # rows without an id don't count against each other
        assert got == sorted([(7, text, 0), (None, "more", 20), (None, "more", 20), (None, "other", 20), (None, rows[4][1], 0), (None, rows[4][1], 0)], key=repr)
        assert [r["__doc"] for r in done.collect()] == ["__doc"] * 6 and done.columns[-3:] == ["__kept", "__n_words", "__n_removed"]


def test_few_slots_change_nothing(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, substring_dedup.dedup_passages(docs).collect()), key=repr)
    monkeypatch.setattr(substring_dedup, "_bits", lambda n: 2048)
    assert sorted(map(tuple, substring_dedup.dedup_passages(docs).collect()), key=repr) == want


def test_passages_of_odd_and_empty_tables(odd_docs, no_docs):
    done = substring_dedup.dedup_passages(odd_docs)
    assert done.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["__n_words"], r["__n_removed"]) for r in done.collect()) == [(False, 0, 0)] + [(False, 14, 0)] * 3 + [(True, 0, 0), (True, 14, 14)]
    assert substring_dedup.dedup_passages(no_docs).count() == 0
