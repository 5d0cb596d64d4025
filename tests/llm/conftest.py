"""Small fixed tables for the text operators: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest

import random

WORDS = "alpha beta gamma delta der die das und le la les est the of and to ein rot blau vert noir gato perro casa".split()


def made_texts(n=60, seed=3):
    """Texts with exact copies, near copies, shared passages and odd shapes."""
    pick = random.Random(seed)
    many = [f"{a}{b}" for a in WORDS for b in ("", "x", "yz", "é")]
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and out:
            out.append(out[pick.randrange(len(out))])
        elif kind == 2 and out and out[-2]:
            words = (out[-2] or "").split(" ")
            words[pick.randrange(len(words))] = pick.choice(many)
            out.append(" ".join(words))
        elif kind == 3 and out and out[0]:
            out.append(" ".join(pick.choice(many) for _ in range(20)) + " " + out[0][10:120])
        else:
            out.append(" ".join(pick.choice(many) for _ in range(pick.randint(1, 120))))
    odd = [None, "", " ", "\t\n", "a", "A", "aa" * 4000, "b " * 3000, "漢字 🙂 é" * 30, "x" * 49, "x" * 50, "...", "123 456"]
    return odd + out + odd[:6]


@pytest.fixture(scope="session")
def texts():
    return made_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids in an order of their own; columns whose names the operators also use inside."""
    rows = [(i * 7 % len(texts), t, "en", f"s{i % 3}", i, "k", True) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, keep_id string, n bigint, _text string, _contaminated boolean"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def by_id(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
