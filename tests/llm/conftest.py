from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, n string, score string, held_out string, medium string, pattern string, size string, class_id string, `segment` string, best string, digest string, type string"
EXTRA = [x.split()[0].strip("`") for x in SCHEMA.split(", ")][5:]


def words(seed: int, n: int, stems=("ka", "lo", "mi", "ter", "sun", "ba", "re", "on", "ti", "vu")) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows, and near and exact copies."""
    base = words(1, 120)
    near = base.rsplit(" ", 2)[0] + " other end"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, near, "en", "a"), (3, near, "en", "a"), (4, None, "en", "a"), (5, "", "en", None), (6, "   \n\t ", None, "b"), (None, words(2, 40), "en", "a"), (None, None, None, None),
        (7, words(3, 30), None, None), (8, words(4, 60_000), "en", "c"), (9, "12345 !!! 678", "en", "c"), (10, "one two three", "en", "c"), (11, "One, two three!", "en", "c"), (12, "é\u0000ü 字 😀 x", "fr", "c"), (13, words(5, 50, ("eux", "ai", "oi", "qu", "é")), "fr", "b"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), *("x" for _ in EXTRA)) for r in rows]


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
