import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows."""

    def build(rows, schema=SCHEMA):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def prose():
    """``prose(n, seed)``: n words in short sentences and lines."""

    def build(n, seed):
        r = random.Random(seed)
        out = []
        for i in range(n):
            word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
            end = r.random()
            out.append(word + (". " if end < 0.1 else ".\n" if end < 0.15 else ", " if end < 0.2 else " "))
        return "".join(out)

    return build


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls in any column, empty and blank texts, ties, repeated rows, a very long text, one short word."""
    long = prose(20_000, 99)
    return [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, " \n\t ", None, "a"),
        (None, prose(60, 1), "en", "b"),
        (None, prose(60, 2), None, None),
        (4, prose(80, 3), "en", "a"),
        (4, prose(80, 3), "en", "a"),
        (5, prose(80, 3), "en", "b"),
        (6, long, "en", "c"),
        (7, "word", "en", "c"),
        (8, "WORD", "en", "c"),
        (9, "ÄÖ ü ñandú 日本語 don't 12ab², x", "de", "c"),
    ]
