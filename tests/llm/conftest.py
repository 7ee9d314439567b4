import random

import pytest

WORDS = [f"w{i}" for i in range(60)] + ["Ärger", "naïve", "日本", "x#y", "Zed!", "a-b"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows(seed=3):
    """Null, empty, blank, very long, repeated and nearly equal texts, ids out of order."""
    rng = random.Random(seed)
    base = [sentence(rng, n) for n in (1, 2, 3, 9, 12, 13, 14, 25, 40, 80, 200, 400)]
    texts = [None, "", " \t\n", "\n\n", *base, base[-1], base[-1], base[9].upper()]
    for text in base[-3:]:
        for _ in range(6):
            words = text.split()
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    texts.append(base[8] + "\n" + sentence(rng, 30) + "\n" + base[8].upper() + "\n" + base[8])
    texts.append(sentence(rng, 15) + " " + base[10] + " " + sentence(rng, 5))
    texts.append("\n".join([sentence(rng, 6), "common line here", sentence(rng, 7), "  COMMON line here\t", "short"]))
    texts.append("common line here\n" + sentence(rng, 8) + "\nshort")
    texts.append("\n".join(sentence(rng, 40) for _ in range(300)))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="session")
def odd(spark):
    """Extra columns have the names that operators give their results."""
    rows = [(i, t, 7, "x", None, 0) for i, t in odd_rows()]
    schema = "doc_id bigint, text string, n_words bigint, items string, shard int, component_id int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def plain_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
