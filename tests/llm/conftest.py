import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use themselves.
CLASHES = "row long, node string, copy string, score string, n_words string, halo string, word string, part string, kept string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(n: int, seed: int = 1) -> str:
    """n seeded words, lines of eleven."""
    out, x = [], seed * 7919 + 1
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x % len(WORDS)] + str(x // 64 % 97) + ("\n" if i % 11 == 10 else " "))
    return "".join(out)


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = prose(60_000, 5)
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "  \n\t ", "en", None, 5), (4, long, "en", "a", None), (4, long, "en", "a", None),
        (None, prose(80, 2), "en", "b", 3), (None, None, None, None, None), (7, "one", "de", "b", 3), (8, "é ß 漢字 🙂 x", "de", "b", 3), (9, prose(80, 3), "en", "b", 3),
        (10, prose(80, 3), "en", "b", 3), (11, prose(300, 4), "fr", "c", 3), (11, prose(300, 6), "fr", "c", 3), (12, "aaaa " * 2000, "fr", "c", 3), (13, "x" * 5000, "fr", "c", 3),
    ]
    return rows


@pytest.fixture(scope="session")
def spark():
    from oddrows.session import local_session

    session = local_session("llm", "8", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names clash."""
    extra = tuple(f"x{i}" for i in range(8))
    return spark.createDataFrame([(*r, 5, *extra) for r in odd_rows()], f"{DOC}, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], f"{DOC}, {CLASHES}")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
