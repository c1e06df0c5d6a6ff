import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """n words, each sentence nine or so."""
    import random

    r = random.Random(seed)
    out = []
    for k in range(n):
        w = r.choice(WORDS) + r.choice(WORDS)
        out.append(w + ("." if k % 9 == 8 else ""))
    return " ".join(out)


#: Documents that are awkward in every way; other columns clash with names that operators use inside.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "One  two\nthree"),
    (6, "one two three"),
    (7, prose(1, 200)),
    (8, prose(1, 200)),
    (8, prose(1, 200)),
    (9, prose(2, 6000)),
    (None, prose(1, 200)),
    (None, None),
    (10, "x" * 50_000),
    (11, "é ü ß  ... !!! 日本語 🙂 <|endoftext|> don't"),
]
ODD_SCHEMA = "doc_id long, text string, hash long, `class` string, score double, token int, digest string, salt int, n long, id string, component int, __covered string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(d, t, None, "c", 0.5, 1, None, 2, 3, "i", None, "k") for d, t in ODD], ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
