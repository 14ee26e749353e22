import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, label string"


@pytest.fixture(scope="session")
def texts():
    """Random prose with copies, empty, null and very long texts, and repeated rows."""
    r = random.Random(4)
    words = ["the", "of", "and", *("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400))]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [(i, prose(r.randint(1, 120))) for i in range(60)]
    base = prose(90).split()
    for i in range(60, 75):
        copy = list(base)
        for _ in range(i % 4):
            copy[r.randrange(90)] = r.choice(words)
        out.append((i, " ".join(copy)))
    out += [(80, None), (81, ""), (82, " \n\t "), (83, "one two"), (84, "One  TWO"), (85, prose(9000)), (86, out[3][1]), (86, out[3][1]), (None, "text without id"), (87, "ünïcode wörds — “quoted” 日本語")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, None if (i or 0) % 9 == 0 else "en", None if (i or 0) % 5 == 0 else "src0", None, "clash", None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
