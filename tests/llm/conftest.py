import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, key long, comp string, row int, host string"


def words(rng, n, stock=400):
    return " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(stock)) for _ in range(n))


def rows(seed=1, n=60):
    """Plain texts, exact and near copies, shared lines, and every odd case; extra columns have names that operators use."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        lines = [words(rng, rng.randrange(12, 40), 4000) for _ in range(3)]
        if i % 3 == 0:
            lines.insert(1, "All rights reserved by nobody in particular 2024")
        texts.append("\n".join(lines))
    near = texts[0].split(" ")
    near[7] = "changed"
    texts += [texts[0], " ".join(near), texts[1].upper(), None, "", " \n\t ", "one", "one two three", "ONE  two\nthree", "a b c d e f g h " * 12, words(rng, 6000), "ünï çödé ß 漢字 😀 " * 9, "[]{} 123 !?", "\x0b\x0c\x1c mixed \x85 space　here"]
    found = [(i, t, "en" if i % 2 else "fr", "s0" if i % 3 else "s1", None if t is None else len(t), "x", 1, "y", 2, "h") for i, t in enumerate(texts)]
    found.append(found[5])  # a repeated row
    found.append((None, texts[2], None, None, None, None, None, None, None, None))
    return found


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in rows()]
