import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASHING = {"keep_id": "int", "kept": "string", "n_words": "string", "fp": "string", "spans": "int", "row": "int", "_text": "int", "ids": "int"}


def corpus(n=120, seed=7):
    """Documents with copies, near copies, shared passages, personal data, junk, nulls and a very long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def prose(k):
        return " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."

    shared = prose(40)
    texts = []
    for i in range(n):
        t = "\n".join(prose(rng.randint(5, 60)) for _ in range(rng.randint(1, 4)))
        if i % 9 == 0:
            t += " " + shared
        if i % 11 == 0:
            t += f" mail a.b+{i}@x{i}.example.org or +1 (555) 123-45{i:02d}, 10.0.0.{i}, 4111 1111 1111 1111 café"
        texts.append(t)
    for i in range(0, n, 10):
        texts.append(texts[i])
        texts.append(texts[i] + " Tail.")
    texts += [None, "", "   ", "\n\n", "x", "a" * 5000, "ab " * 3000, " ".join(prose(50) for _ in range(400)), "é" * 300, "WORD!! " * 80]
    rng.shuffle(texts)
    return [(i, t, "en" if i % 3 else "de", f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, repeated rows and ids, and clashing extra columns."""
    from pyspark.sql import functions as F

    rows = [
        (None, None, None, None, None), (None, "some text here", "en", None, 3), (1, None, None, "s", None), (1, None, None, "s", None),
        (2, "", "en", "s", 0), (3, "the same text, told twice over", "en", "s", 1), (3, "the same text, told twice over", "en", "s", 1),
        (4, "the same text, told twice over", "de", "s", 1), (-5, "word " * 200, "de", "s", 1), (9, "z" * 3000, None, "s", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({k: F.lit(None).cast(v) for k, v in CLASHING.items()})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
