"""Small tables with the hard cases: nulls, blanks, ties, repeated rows, long texts, clashing columns."""
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "re", "su", "té"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def near(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = sentence(rng, 1)
    return " ".join(words)


def rows_of(rng: random.Random) -> list[tuple]:
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "One", "en", None, 3), (5, "one", "en", "b", 3)]
    base = [sentence(rng, n) for n in (30, 60, 120, 5, 4, 300)]
    number = 10
    for text in base:
        for edits in (0, 0, 1, 2, 3, 6):
            rows.append((number, near(rng, text, edits) if edits else text, "en", rng.choice("abc"), len(text)))
            number += 1
    shared = sentence(rng, 60)
    for _ in range(8):
        rows.append((number, f"{sentence(rng, 50)}\n{shared}\n{sentence(rng, 50)}", "de", "a", 1))
        number += 1
    rows.append((number, sentence(rng, 30_000), "en", "c", 1))
    rows += [(number + 1, "Same row twice " * 9, "en", "b", 1)] * 2
    rows += [(None, base[0], "en", "b", 1), (-7, base[1].upper(), "en", "b", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return rows_of(random.Random(3))


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """With columns named like those of the operators."""
    from pyspark.sql import functions as F

    names = "n size token tokens row key kind a b c f g k v u id rank copies target _key _words _keys _pairs _cell _kept _n llr kept score bucket held_out".split()
    return docs.select("*", *[F.lit(7).alias(n) for n in names])
