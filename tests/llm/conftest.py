import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, th long, sig long, score double, held_out boolean, bin string, g long, gone int, component_id long"


def words(rng, n, kinds=4000):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty values, texts without words, one word, a very long text, copies, near copies, repeated rows, and columns with clashing names."""
    rng = random.Random(1)
    base = words(rng, 120)
    lines = "\n".join(words(rng, 14) for _ in range(8))
    long = "\n".join(words(rng, 300) for _ in range(80))
    texts = [None, "", "   ", "\n\n", "one", "two words", base, base, base.replace(" w", " W", 1), base + " tail", long, lines, lines.replace("w1", "w2", 1), "…", "123 456", "word " * 60]
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "s1", "s2"][i % 3], 0, 1, 2, 3, 4, 0.5, True, "b", 7, 8, 9) for i, t in enumerate(texts)]
    rows += [rows[6], rows[11], (None, base, None, None, None) + (None,) * 10, (None, None, None, None, None) + (None,) * 10]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
