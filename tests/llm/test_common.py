import random
import re

import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm import common


def test_words_are_cut_and_hashed_alike_in_any_chunk(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "a b  c\td", "é x\x0b", "a b\x1cc"] + ["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(50))) for _ in range(200)]
    seen = {}
    for size in (1 << 20, 150, 7):
        monkeypatch.setattr(common, "CHUNK_BYTES", size)
        rows = 0
        for low, high, words in common.text_chunks(pa.array(texts, pa.string())):
            hashes = words.hashes()
            rows += high - low
            for row in range(low, high):
                want = re.findall(r"[^\x20\x09-\x0D]+", texts[row] or "")
                a, b = words.first[row - low], words.first[row - low + 1]
                assert [words.text(k).decode() for k in range(a, b)] == want
                assert all(seen.setdefault(w, h) == h for w, h in zip(want, hashes[a:b], strict=True))
        assert rows == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_grams_stay_in_their_row():
    (_, _, words), = common.text_chunks(pa.array(["a b c", "b c", "", "a b c"]))
    whole, hashes = common.inside(words, 2), common.grams(words.hashes(), 2)
    assert whole.tolist() == [True, True, False, True, False, True, True]
    assert hashes[0] == hashes[5] and hashes[1] == hashes[3] == hashes[6] and hashes[0] != hashes[1]


def test_components_of_chain_and_hub(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(50, 50)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(101, 141)} | {k: 7 for k in range(8, 30)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [100, 0])
def test_lookup_with_null_keys(spark, limit):
    rows = spark.createDataFrame([(k % 3 if k % 4 else None, k) for k in range(40)], "key long, v long")
    small = spark.createDataFrame([(0, "zero"), (1, "one"), (None, "none")], "key long, name string")
    got = {(r["key"], r["v"], r["name"]) for r in common.lookup(rows, small, ["key"], limit).collect()}
    assert got == {(k % 3 if k % 4 else None, k, {0: "zero", 1: "one", 2: None}[k % 3] if k % 4 else "none") for k in range(40)}


def test_arrays_sum_over_tasks(spark):
    def part(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from common.pack_arrays(np.arange(64) * k, 8)

    parts = spark.range(10, numPartitions=3).mapInArrow(part, "block int, counts binary")
    assert common.unpack_arrays(common.sum_arrays(parts, 8), 8, 64).tolist() == (np.arange(64) * 45).tolist()


def test_hashes_depend_on_the_whole_word_alone():
    """Words of all lengths around the block and side-by-side limits, and words that polynomial sums mix up."""
    rng = random.Random(7)
    alike = ["".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(1024)) for flip in (0, 1)]
    kinds = alike + ["".join(rng.choices("xy", k=n)) + tail for n in (*range(1, 26), 255, 256, 257, 600) for tail in ("", "x", "é")] + ["a", "aa", "a\x00", "\x00", "\x00\x00"]
    kinds = list(dict.fromkeys(kinds))
    seen = {}
    for _ in range(20):
        text = " ".join(rng.choices(kinds, k=60))
        (_, _, words), = common.text_chunks(pa.array([text]))
        first, second = words.wide_hashes()
        assert (first == words.hashes()).all()
        for word, a, b in zip(text.split(" "), first.tolist(), second.tolist(), strict=True):
            assert seen.setdefault(word, (a, b)) == (a, b)
    assert len({a for a, _ in seen.values()}) == len({b for _, b in seen.values()}) == len(seen)


def test_grams_depend_on_order_and_width():
    turns = [bin(k).count("1") % 2 for k in range(64)]
    text = " ".join(["left", "right"][t] for t in turns)
    (_, _, words), = common.text_chunks(pa.array([text]))
    hashes = words.hashes()
    for n in (1, 2, 3, 5, 7, 12, 13, 16, 25, 32, 64):
        seen = {}
        for k, h in enumerate(common.grams(hashes, n).tolist()):
            assert seen.setdefault(tuple(turns[k : k + n]), h) == h
        assert len(set(seen.values())) == len(seen)
    assert not set(common.grams(hashes, 4).tolist()) & set(common.grams(hashes, 5).tolist()) and not len(common.grams(hashes, 65))
