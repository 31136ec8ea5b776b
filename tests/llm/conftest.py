import random

import duckdb
import pytest

SYLLABLES = "ba ke li mo nu ra se ti vo za".split()


def prose(rng, words):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words))


def corpus(seed=5, size=60):
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared lines and passages, and odd texts."""
    rng = random.Random(seed)
    passage, line = prose(rng, 40), "This line stands in many documents"
    texts = []
    for k in range(size):
        text = ".\n".join(prose(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 5)))
        if k % 5 == 1:
            text = text + " " + passage + " end" + str(k)
        if k % 4 == 2:
            text = text + "\n  " + (line.upper() if k % 8 == 2 else line) + "\t\n" + prose(rng, 6)
        if k % 6 == 3 and texts:
            words = texts[rng.randrange(len(texts))].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if k % 7 == 4 and texts:
            text = texts[rng.randrange(len(texts))]
        texts.append(text)
    texts += [None, "", " \n\t ", "short", "short", "two words", "x" * 5000, prose(rng, 6000), "ça é ü\nça é ü", "a b c d e " * 30, "#$% " * 50, "same line here\nsame line here\n\nsame line here"]
    sources, langs = ["s1", "s2", None, "ä", "hot", "hot", "hot"], ["en", None, "de"]
    return [(3 * k + 1, t, langs[k % 3], sources[k % 7], len(t or "")) for k, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Tables of a small corpus."""
    base = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(3)
    docs = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{base}/documents.parquet")
    pages = [(k, f"http://x.example/{k} a", "<p>" + prose(rng, 60 if k % 3 else 2) + "</p>") for k in range(40)]
    pages += [(100 + k, None, pages[5 * k][2]) for k in range(6)] + [(200, "http://e", None), (201, "http://e", ""), (202, "http://e", "é" * 100 + "\r\n\r\nWARC/1.0\r\n")]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{base}/pages.parquet")
    vectors = [(k, [rng.choice((-1.0, 0.25, 0.5, 1.5)) for _ in range(6)], 0) for k in range(130)]
    vectors += [(140, None, 0), (160, [None] * 6, 0), (180, [float("nan")] * 6, 0), (181, [float("inf")] * 6, 0), (200, [1.5] * 6, 0), (201, [1.5] * 6, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{base}/embeddings.parquet")
    return base


@pytest.fixture(scope="session")
def same_as_sql(spark, folder):
    def compare(module, name):
        got = module.QUERIES[name](spark, folder)
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
        want = con.sql(module.ORACLES[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
        assert rows == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)
        return rows

    return compare


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Repeated rows, null ids, and extra columns whose names the operators use inside."""
    rows = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1)] * 3
    rows += [(None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", None, None, 2), (None, None, None, None, 0), (2, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for name in ("size", "hash", "tokens", "doc", "shard", "label", "component", "id", "rank", "score", "n"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, None, None), (7, 0, 1), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
