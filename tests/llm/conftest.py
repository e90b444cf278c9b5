import random

import pytest

#: Cases that every operator on documents must take: null, empty, blank, short, odd characters, repeats, long.
ODD = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (4, "É ß 漢字 😀 <|endoftext|> </s>"), (5, "\x00\x1c  x"), (6, "the cat " * 9000), (7, "same text here"), (8, "same text here")]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The cases, one row twice, with extra columns whose names clash with those that operators make."""
    rows = [(i, t, "en" if i % 2 else None, "src", 1, "digest", 0.5) for i, t in [*ODD, ODD[7]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, score double")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)


def prose(seed, n, words=400, lengths=(5, 40, 200)):
    r = random.Random(seed)
    vocabulary = ["w%dé" % i if i % 7 == 0 else "w%d" % i for i in range(words)]
    return [(100 + k, " ".join(r.choice(vocabulary) for _ in range(r.choice(lengths)))) for k in range(n)]
