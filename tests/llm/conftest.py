import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n: int = 160, seed: int = 5) -> list[tuple]:
    """Invented prose with exact and near copies, shared passages, odd rows and a hot source."""
    r = random.Random(seed)
    stock = ["".join(r.choice("aeioustnrl") for _ in range(r.randint(2, 7))) for _ in range(400)]
    words = lambda k: [r.choice(stock) for _ in range(k)]
    passage = " ".join(words(60))
    rows: list[tuple] = []
    for i in range(n):
        kind = i % 8
        if kind == 1 and i > 8:
            text = rows[r.randrange(len(rows))][1]
        elif kind == 2 and i > 8:
            t = (rows[r.randrange(len(rows))][1] or "x").split(" ")
            t[r.randrange(len(t))] = r.choice(stock)
            text = " ".join(t)
        elif kind == 3:
            text = " ".join([*words(r.randint(5, 30)), passage, *words(r.randint(5, 30))])
        else:
            text = " ".join(words(r.randint(1, 120)))
        rows.append((i, text, "en", "src0" if i % 3 else f"src{i % 7}", len(text or "")))
    return [*rows, (n, None, None, None, None), (n + 1, "", "en", "src0", 0), (n + 2, " \t\n", "en", None, 3), (n + 3, "ÄÖ İstanbul 中文 ok", "de", "ü", 18)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, repeated rows and ids, a very long text, and columns whose names operators use inside."""
    long = "lorem ipsum dolor " * 30_000
    base = [(None, None), (None, "a b c d e"), (1, ""), (1, ""), (2, "same text here for all"), (2, "same text here for all"), (2, "another text"), (3, long), (4, long), (5, "x")]
    data = [(i, t, None, "s", 1, 7, "fp", "h", 0.5, "k", True) for i, t in base]
    return spark.createDataFrame(data, SCHEMA + ", row long, fp string, h string, toxicity double, key string, positive boolean")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
