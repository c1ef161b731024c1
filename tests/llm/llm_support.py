import os
import random

import pytest

SF = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(n))


#: Nulls, empty and long texts, ties, repeated rows.
EDGES = [
    (None, prose(1, 30), "en", "a", 1), (None, None, None, None, None), (1, None, "en", "a", None), (2, "", "en", None, 0),
    (3, " \t\n ", None, "a", 4), (4, prose(4, 40), "en", "a", 5), (4, prose(4, 40), "en", "a", 5), (5, prose(4, 40), "en", "b", 5),
    (6, prose(6, 60_000), "en", "a", 9), (7, "x", "en", "a", 1), (8, "é" * 5000, "fr", "a", 1), (9, prose(9, 50), "en", "a", 1),
    (9, prose(10, 50), "en", "a", 1), (10, "a\0b   c\U0001F600", "en", "a", 1),
]


@pytest.fixture()
def edges(spark):
    """The edge rows, with a column whose name could clash with an operator's."""
    names = ["fp", "row", "n_words", "score", "base", "kept", "h"]
    rows = [(*r, *[k] * len(names)) for k, r in enumerate(EDGES)]
    return spark.createDataFrame(rows, DOCUMENT + "".join(f", {n} long" for n in names))


@pytest.fixture()
def no_rows(spark):
    return spark.createDataFrame([], DOCUMENT)


def table(spark, name: str, sf: str = SF):
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))
