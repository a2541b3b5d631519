"""Small documents with every awkward case, for brute-force comparisons."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, _text string, size long, node long, page long"


def _prose(rng: random.Random, n: int) -> str:
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "tu", "Va") for b in ("", "ra", "sen", "dil", "é", "-x.")]
    return " ".join(rng.choice(words) for _ in range(n))


def small_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    passage, longer = _prose(rng, 60), _prose(rng, 140)
    base = _prose(rng, 120).split(" ")
    near = []
    for _ in range(6):
        copy = list(base)
        copy[rng.randrange(len(copy))] = "changed"
        near.append(" ".join(copy))
    texts = [
        None,
        "",
        " \t\n ",
        "one",
        "one two three four",
        "one two three four",
        "One TWO three four five",
        _prose(rng, 400),
        longer,
        longer,
        longer + " tail",
        passage + "\n" + _prose(rng, 30),
        _prose(rng, 80) + " " + passage,
        passage[: len(passage) // 2] + " " + _prose(rng, 70) + " " + passage,
        " ".join(["again"] * 300),
        " ".join(["again"] * 120),
        "same line\nsame line\n\nother # line $5\nsame line",
        " ".join(base),
        *near,
        "x" * 5_000,
        _prose(rng, 6_000),
        "É\x0bà\x0c b c " * 40,
    ]
    rows = [(n, t) for n, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, passage), (None, None), (8, longer), (40, _prose(rng, 55))]


@pytest.fixture(scope="session")
def small_rows():
    return small_texts()


def table(spark, rows):
    data = [
        (i, t, "en", [None, "b", "a"][n % 3], None if t is None else len(t), "clash", "clash", "clash", 1, 2, 3)
        for n, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def small_docs(spark, small_rows):
    return table(spark, small_rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
