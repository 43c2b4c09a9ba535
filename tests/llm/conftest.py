import random

import pytest

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in "ba ke lo mi nu pa re so ti vu".split() for b in "da fe gi ho ju la me ni po ru".split()]
# Extra columns named like columns that operators make themselves.
CLASHING = "doc_id long, text string, lang string, source string, root string, set_key int, token string, n int, row string, bits string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(text, seed, changes):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a table with clashing extra columns; lang and source null here and there."""

    def made(rows):
        full = [(i, t, None if i == 3 else "en", None if i == 4 else f"s{(i or 0) % 3}", "r", 1, "t", 2, "w", "b") for i, t in rows]
        return spark.createDataFrame(full, CLASHING)

    return made


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, repeated and very long texts, a null id."""
    long = prose(5, 60_000)
    return [
        (0, None),
        (1, ""),
        (2, " \t\n"),
        (3, "one two"),
        (4, "One  TWO"),
        (5, long),
        (6, near(long, 1, 3)),
        (7, "x" * 300_000),
        (8, "same row again and again here"),
        (8, "same row again and again here"),
        (None, "without an id"),
    ]
