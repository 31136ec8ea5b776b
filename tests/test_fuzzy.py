import random

import pytest

from auditlake.operators import fuzzy
from auditlake.rules.packs import LEGIT_CARGO, LEGIT_NPM


def edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def expected(name, legit):
    low = name.lower()
    variants = {low.replace("-", "_"), low.replace("_", "-"), low.replace("@", "")}
    best = None
    for entry in legit:
        other = entry.lower()
        if low == other:
            return None
        if other in variants:
            return (name, entry, 0.95)
        sim = 1 - edit(low, other) / max(len(low), len(other))
        if sim > 0.75 and (best is None or sim > best[2]):
            best = (name, entry, sim)
    return best


def names_near(legit, seed, n=120):
    rng = random.Random(seed)
    out = ["solana_sdk", "anchor_lang", "serde", "borsh", "Borsh", "@borsh", "a", "ab"]
    for _ in range(n):
        word = list(rng.choice(legit))
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(word) + 1)
            kind = rng.randrange(3)
            if kind == 0 and i < len(word) and len(word) > 1:
                del word[i]
            elif kind == 1:
                word.insert(i, rng.choice("abcxyz-_"))
            elif i < len(word):
                word[i] = rng.choice("abcxyz-_")
        out.append("".join(word))
    return out


@pytest.mark.parametrize("legit, seed", [(LEGIT_CARGO, 1), (LEGIT_NPM, 2), (["abc", "ab-c", "ab_c", "abcd", "x"], 3)])
@pytest.mark.parametrize("joined", [False, True])
def test_typosquats_match_list_order_semantics(spark, legit, seed, joined):
    names = names_near(legit, seed)
    df = spark.createDataFrame([(n,) for n in names + names], "name string")
    table = spark.createDataFrame(list(enumerate(legit)), "pos long, legit string") if joined else legit
    got = {r["name"]: (r["name"], r["likely_target"], round(r["similarity"], 9)) for r in fuzzy.typosquats(df, table).collect()}
    want = {n: expected(n, legit) for n in names}
    assert got == {n: (w[0], w[1], round(w[2], 9)) for n, w in want.items() if w}
