import random

import pytest

EXTRA = ["key", "row", "rid", "host", "size", "start", "name", "doc"]


def prose(rng: random.Random, n: int) -> str:
    """n words, some of them capital, with lines and odd letters."""
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwéß") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return "".join(w + rng.choice([" "] * 8 + ["  ", "\n", "\t", ". "]) for w in words)


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows (doc_id, text, lang, source, n_chars) with everything that tables may hold, and extra columns with clashing names."""
    rng = random.Random(11)
    long, base, shared = prose(rng, 9000), prose(rng, 300), prose(rng, 90)
    near = base.split(" ")
    near[40] = "CHANGED"
    texts = [None, "", " \n\t ", "word", "one two three", base, base, " ".join(near), long, shared + prose(rng, 80), prose(rng, 70) + shared, "a " * 400, "b" * 900, "b" * 900, "é" * 600, shared, prose(rng, 60) * 3, "x\n" * 60 + prose(rng, 60)]
    rows = [(i, t, "en", rng.choice(["s1", "s2", "s2", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (3, "a different text with the id three", "de", None, 3), (None, base, None, None, None), (None, None, None, None, None), (None, prose(rng, 50), "fr", "s1", 1), (-7, shared, "en", "s9", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA:
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df.cache(), rows


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward[0].filter("false")


@pytest.fixture(scope="session")
def documents(spark):
    """The driver's smallest table."""
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path
