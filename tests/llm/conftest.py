"""Small tables with the awkward cases that every text operator must bear."""

import random

import pytest

SYLLABLES = ["tor", "na", "wel", "shi", "qua", "lo", "é", "ñu", "ing", "the", "of", "99", "Ab", "ZU"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, KEPT string, size string"


def prose(rng, words):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words))


def odd_rows():
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows, clashing column names."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(1, 90)) for _ in range(40)]
    long = prose(rng, 20000)
    passage = prose(rng, 60)
    texts = [*base, None, "", "  \n\t ", None, "", base[3], base[3].upper(), base[3], base[7] + " end", long, long,
             f"{base[1]} {passage} {base[2]}", f"{passage}\n{base[4]}", f"{base[5]}\r\n{passage}", "word", "Word", "\x1c\xa0　",
             "mail a.b@c.example.org, +1 (811) 555-3281 or 10.0.0.255 4012 8888 8888 1881", "x" * 5000, "<|endoftext|> a  b"]
    rows = [(n, text, rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "b", "c", None]), len(text or ""), "s", "k", "z")
            for n, text in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, "no id here", None, None, None, None, None, None),
            (None, None, None, None, None, None, None, None), (None, "no id here", None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def unique(odd):
    """The rows with an id of their own."""
    return odd.where("doc_id is not null").dropDuplicates(["doc_id"])


@pytest.fixture(scope="session")
def known(spark):
    """Labels with repeated, missing and foreign values."""
    rows = [(n, n % 3 != 0, False) for n in range(50)]
    return spark.createDataFrame([(n, int(q), int(t)) for n, q, t in rows] + [(None, 1, 0), (5, 1, 0), (7, None, 0), (9, 4, 1)],
                                 "doc_id bigint, quality int, toxic int")
