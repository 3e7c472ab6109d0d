"""Fixtures of both test files. Not a conftest, as the tests above import theirs by that name."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, Doc_Id string, key binary, part int, row string, spans string"


def _texts():
    rnd = random.Random(7)
    words = "the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda été über año".split()

    def prose(n):
        return " ".join(rnd.choice(words) + rnd.choice(["", "", ",", "."]) for _ in range(n))

    shared = "This Long Line stands in several documents, word for word, and so has to go."
    body = "\n".join(prose(12) for _ in range(6))
    out = [None, "", " ", "\n\n", "one", "one two", body, body, body + "\nand one more line", shared]
    out += [f"{prose(30)}\n  {shared.upper() if i % 2 else shared}\t\n{prose(25)}" for i in range(8)]
    out += [prose(60), prose(5), "x" * 5000, "a b " * 3000, "\n".join(["same line again and again in a document"] * 50)]
    out += ["é" * 3000 + "\r\n\x0b tab\tend", "👍🏽 naïve text　here \x1c 12²", prose(9000)]
    return out


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source): nulls, empty and long texts, ties and repeated rows; ids not in order."""
    texts = _texts()
    found = [(100 - 3 * i, t, ("a", "b", None)[i % 3]) for i, t in enumerate(texts)]
    return found + [found[6], found[10], (None, texts[11], "a"), (100 - 3 * 12, "another text under an id that repeats", "b")]


@pytest.fixture(scope="session")
def messy(spark, rows):
    """The same as documents, with other columns whose names clash with wanted and inner ones."""
    return spark.createDataFrame([(i, t, "en", s, 0, "no", "no", b"no", 1, "no", "no") for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
