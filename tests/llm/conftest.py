import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, lines string, w string, items string, at int, score string"


@pytest.fixture(scope="session")
def nasty(spark):
    """Null ids, texts and sources, empty and very long texts, repeated rows, copies, and columns with names that operators use inside."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = prose(120)
    near = base.replace(" ", "  ", 3) + " tail"
    lines = "\n".join([prose(30), prose(40), "", prose(12)])
    texts = [None, "", "   \n\n ", "word", "two words", base, base, near, base.upper(), lines, lines + "\n" + prose(20), prose(7) + "\n" + lines,
             prose(20_000), "x" * 100_000, "Ünï " * 70, "!!! ### $$$", prose(60) + "\n\n\n" + prose(60), "a\n" * 150]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base), (None, None), (5, base), (5, base), (9, prose(80)), (40, prose(300))]
    made = [(i, t, "en", None if k % 7 == 3 else f"s{k % 3}", len(t or ""), "x", 1, "y", "z", "q", 2, "s") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
