import random

import pytest

SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]


def invented(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.choice([1, 1, 2, 3, 4]))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", "."]) for w in words)


@pytest.fixture(scope="session")
def rows():
    """Edge rows, exact copies, near copies and plain documents: (doc_id, text, lang, source, key)."""
    rng = random.Random(7)
    base = [invented(rng, rng.randint(5, 300)) for _ in range(60)]
    out = [None, "", "  \n\t ", "one", "one two", "One Two", "a\x0bb c\x85d e　f", "é日本 😀 " * 30, "x" * 5000]
    out += base + [base[3].upper(), base[3], base[4]]
    for t in base[10:20]:
        w = t.split()
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    out.append(" ".join(invented(rng, 30) for _ in range(300)))
    made = [(i, t, "en" if i % 3 else None, [None, "a", "b", "c", "d"][i % 5], i * 2) for i, t in enumerate(out)]
    return made + [made[20], made[20]]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key long").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, key long")
