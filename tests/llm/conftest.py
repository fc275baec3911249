import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text[, lang]) as documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Prose with exact copies, near copies, shared passages, junk, and the odd cases: null, empty, white space, one word, long."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice(["an", "er", "the", "o", "is", "ti", "é", "ß", "wo", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, passage = [], words(rng, 40, vocabulary)
    for k in range(60):
        text = words(rng, rng.randint(5, 120), vocabulary)
        if k % 7 == 0:
            text += ". " + passage
        rows.append((k, text))
    for k in range(60, 75):
        rows.append((k, rows[k % 5][1]))
    for k in range(75, 95):
        own = rows[10 + k % 4][1].split(" ")
        own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((k, " ".join(own)))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "word"), (104, "word"), (105, "Two words"), (106, "two WORDS"), (107, words(rng, 6000, vocabulary)), (108, "x" * 3000), (109, "x" * 2990), (None, rows[0][1]), (7, rows[7][1]), (8, "another text under a known id " * 3)]
    return rows
