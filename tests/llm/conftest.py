import random

import pytest

WORDS = "an stone river light cold wind seven glass paper moon night road house garden bread table window letter song bird".split()


def text(r: random.Random, low: int, high: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(r.randint(low, high)))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): plain texts, exact and near copies, short, empty, null, odd and very long ones."""
    r = random.Random(7)
    out = [(i, text(r, 1, 120), "en", f"s{i % 3}") for i in range(60)]
    base = text(r, 200, 200)
    for i in range(60, 90):  # near copies of one text
        w = base.split()
        for _ in range(r.randint(1, 12)):
            w[r.randrange(len(w))] = "changed" + str(r.randint(0, 99))
        out.append((i, " ".join(w), "en", "hot"))
    out += [(i, base, "en", "hot") for i in range(90, 100)]
    out += [(100, None, None, None), (101, "", "en", "s1"), (102, "   \n\t ", "en", "s1"), (103, "one two", "en", None), (104, "One TWO", "en", "s2"), (105, "x", "en", "s2")]
    out += [(106, "é日本\U0001f600  x\n\n y <|endoftext|> don't\x1c z\xa0q", "fr", "s1"), (107, text(r, 9000, 9000), "en", "s0"), (None, "no id here at all", "en", "s0"), (108, "12345 67890 !!! ---", "en", "s2")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as documents, with an extra column whose name an operator might use inside."""
    return spark.createDataFrame([(*x, len(x[1] or ""), i % 2) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, n long").repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
