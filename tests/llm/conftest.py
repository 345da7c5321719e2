import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, score double, bin long, vector string"


def frame(spark, rows):
    """documents-like rows from (id, text), with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, "k", 1, 0.5, 7, "v") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 9))) for _ in range(4000)]


@pytest.fixture(scope="session")
def edge_rows(words):
    """Nulls, empty and blank texts, ties, repeated rows, near copies and one very long text."""
    rng = random.Random(4)
    base = [rng.choice(words) for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    passage = " ".join(rng.choice(words) for _ in range(70))
    long = "\n".join(" ".join(rng.choice(words) for _ in range(40)) for _ in range(700))
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "two words"), (8, "two  WORDS"),
            (9, long), (10, "a line that is shared\nown line nine\nA Line That Is SHARED "), (11, "a line that is shared\nanother one here"),
            (12, "lead " + passage + " tail"), (13, passage + " und Ähre ÄHRE"), (14, "tok tok tok tok tok tok tok tok tok tok tok tok"), (14, "tok tok tok tok tok tok tok tok tok tok tok tok"),
            (None, "null id text with some words of its own here"), (15, "x" * 3000), (16, "ab" * 400), (17, long[:900] + "é" + long[900:2000])]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return frame(spark, edge_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
