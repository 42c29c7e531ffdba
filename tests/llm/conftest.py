import random

import pytest

WORDS = "the of and house river stone light water green field wind north summer road bridge garden paper silver morning letter".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, a long, k string, hi long, n long"


def prose(rng, n, line=9):
    out = [rng.choice(WORDS) + rng.choice(["", "", "er", "ing", "s"]) for _ in range(n)]
    return "\n".join(" ".join(out[i : i + line]) for i in range(0, n, line))


def make_rows():
    """Documents with nulls, empties, repeats, ties, a long text, near copies, shared passages, and columns that operators use inside."""
    rng = random.Random(7)
    base = prose(rng, 400)
    words = base.split(" ")
    near = list(words)
    near[30] = "changed"
    passage = prose(rng, 120)
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: prose(rng, 300), 5: "", 6: None, 7: "   \n\t ", 8: "one two", 9: "One TWO", 10: "12345 !!!",
        11: prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 60), 12: passage + "\n" + prose(rng, 90), 13: "é" * 700, 14: prose(rng, 8000),
        15: "Übergrößenträger für die Straße und das Mädchen im Wald " * 3, 16: "x" * 5000, 17: "a\nb\nc\na\nb\nc\nd",
    }
    lang = {15: "de"}
    rows = [(d, t, lang.get(d, "en" if d % 2 else None), "s", 0, 1.5, "clash", 9, "clash", 8, 7) for d, t in texts.items()]
    rows += [rows[0], rows[0], (None, base, "en", None, None, None, None, None, None, None, None), (None, "null id alone " * 40, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
