"""Small tables with the awkward cases every operator has to answer."""

import pytest

SENTENCE = "the quick brown fox jumps over the lazy dog and runs away from the noisy crowd. "


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and blank texts, a null id, repeats, a long text, and columns named like results."""
    rows = [
        (1, SENTENCE * 3, "en", 9),
        (2, None, "en", 9),
        (3, "", None, 9),
        (4, " \n\t ", "de", 9),
        (None, SENTENCE + "mail me@example.org", "en", 9),
        (6, SENTENCE * 3, "en", 9),
        (6, SENTENCE * 3, "en", 9),
        (7, "word " * 30_000, "en", 9),
        (8, "größe straße über für und nicht mit dem haus " * 5, "de", 9),
        (9, "12345 ++ !!", None, 9),
    ]
    clashing = ", score int, words int, start int, length int, fp int, lang_pred int, value int"
    return spark.createDataFrame([(*r[:3], *[r[3]] * 7) for r in rows], "doc_id long, text string, lang string" + clashing)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
