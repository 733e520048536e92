"""Small tables with the odd cases that every operator must take."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ba", "te", "ko", "lu", "mi", "sha", "ré") for b in ("n", "rd", "st", "ve", "xo", "ña")]


def prose(rng: random.Random, n: int) -> str:
    """n invented words, several to a line."""
    out = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(out[i:i + 12]) for i in range(0, n, 12))


def odd_documents() -> list[tuple]:
    """(doc_id, text): nulls, empty and long texts, exact and near copies, repeated rows, shared lines."""
    rng = random.Random(7)
    shared = "This very line Stands in many documents of this little table"
    rows = [(i, prose(rng, 20 + 7 * i)) for i in range(40)]
    rows += [(100 + i, f"{prose(rng, 30)}\n  {shared.upper() if i % 2 else shared}\t\n{prose(rng, 10)}")
             for i in range(8)]
    base = prose(rng, 200).split(" ")
    for i in range(30):                                # a family of near copies larger than a small group
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, rows[3][1]), (301, rows[3][1].replace("\n", " ")), (302, ""), (303, None), (304, "  \n\t "),
             (305, "one two"), (306, "one two"), (307, "x" * 30_000), (308, prose(rng, 4000)), (None, rows[5][1]),
             (None, None), (309, "É" * 50 + "\n" + "é" * 50), (310, "a  b \n c\n\nd <|endoftext|> 12.5, it's")]
    return rows + [rows[2], rows[2]]


DOCS = "doc_id long, text string, h1 string, cls int, position string"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents, with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "a", 1, None) for r in odd_documents()], DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", F.col("text")).collect()]
