import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id long, n_words long, fail_bits long, _row string, _t long, word string, weight double"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu ra re ri ro ru sa se si so su ta te ti to tu".split()
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), "x", 7, 3, 5, "r", 9, "w", 0.5)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and odd texts, repeated rows, copies, a very long text, ties."""
    long = "\n".join(prose(i, 60) for i in range(150))
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [
        row(1, base), row(2, base), row(3, near), row(3, near), row(4, None), row(5, ""), row(6, " \n\t "), row(None, prose(2, 80), None), row(7, "one"), row(8, "zwei\x0bdrei\x0cvier fünf \U0001f600 é"),
        row(9, long, "b"), row(10, "dup line here now again\n" * 5 + prose(3, 50)), row(11, "### $$$ " * 40), row(12, prose(4, 200), "b"), row(13, "tick " * 90), row(14, "0 1 2 3,5 <|endoftext|> it's"),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
