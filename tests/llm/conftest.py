"""Small documents with the awkward cases every operator must take."""

import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec".split()


def prose(seed: int, n: int) -> str:
    """n words that repeat no five-word run within or between seeds."""
    return " ".join(f"{WORDS[(seed * 7 + i * 3) % len(WORDS)]}{seed}x{i}" for i in range(n))


AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t", None, None), (4, "One", "en", "a"),
    (5, prose(5, 30), "en", "a"), (5, prose(5, 30), "en", "a"), (6, prose(5, 30), "de", "b"),
    (None, prose(7, 70), "en", "a"), (8, prose(8, 3000), "en", None), (9, "日本語 テキスト 🎉 é x", "ja", "b"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, blanks, repeated rows, one id with copies, a long text, and columns with names the operators use."""
    rows = [(*r, len(r[1] or ""), "mine", 1, 2) for r in AWKWARD]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, node int, n_words int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.where("false")
