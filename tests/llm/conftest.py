import random

import pytest

#: Columns that a documents table has, and some that clash with names used inside the operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, n int, size string, key string, score double"

WORDS = {
    "en": "the of and to in is that for with from thing house water river street morning".split(),
    "de": "der die das und nicht mit für straße haus wasser fluss morgen über gegen schon".split(),
    "fr": "le la les des une avec pour rivière maison matin être très déjà toujours eau".split(),
}


def prose(lang: str, n: int, rng: random.Random) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), 1, 2, "x", "y", 0.5)


@pytest.fixture(scope="session")
def docs(spark):
    """Prose in three languages with nulls, an empty and a long text, copies, repeated rows and a hot source."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        rows.append(row(i, prose(lang, rng.randint(5, 60), rng), lang, "hot" if i % 2 else f"s{i % 5}"))
    rows += [row(300, None), row(301, ""), row(302, " \n\t "), row(303, "1234 !!! 77"), row(304, prose("en", 9000, rng)), row(305, rows[4][1]), row(306, rows[6][1].upper())]
    rows += [row(307, rows[7][1] + " extra", "de", None), (308, rows[9][1], None, None, None, None, None, None, None, None), rows[11], rows[11]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
