"""Regions of the field against the whole text as one region."""

from __future__ import annotations

import random

import pytest

from spanvigil.llm import pii


@pytest.fixture(scope="module")
def model():
    field = pii.SegmentField()
    field.learn(pii.examples_from(pii.synthetic_texts(random.Random(5))))
    return field


def test_digits_before_a_datum_change_nothing(model):
    for datum in ("(743) 555-3824", "john @ mail.example.com", "4539 . 1488 . 0343 . 6467"):
        for gap in range(90, 165):
            filler = ("lorem ipsum dolor sit amet " * 8)[: gap - 1] + " "
            for end in (" after noon", ""):
                plain, marked = "x" + filler + datum + end, "7" + filler + datum + end
                assert pii.find_spans(marked, model) == pii.find_spans(plain, model), (datum, gap)
                assert pii.find_spans(plain, model)[1] or datum[0] != "("


def test_an_address_keeps_its_right_side():
    field = pii.SegmentField({("email", "at=True"): 3.0})
    for gap in range(90, 165):
        text = ("lorem ipsum dolor sit amet " * 8)[: gap - 1] + " john @ mail.example.com after"
        plain = pii.find_spans("x" + text, field)
        assert plain[1] and pii.find_spans("7" + text, field) == plain, gap


def test_regions_hold_every_candidate(model):
    rng = random.Random(4)
    parts = ["word", "Wort", "12", "345", "@", ".", "-", " ", "  ", "\n", "(", "+", "_", "é", "x9", "lengthy" * 12, "٣a"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 200)))
        whole = pii.region_of(text, 0, len(text))
        want = {(whole.tokens[i][0], whole.tokens[j - 1][1]) for i, j in whole.candidates}
        got = []
        for low, high in pii.regions(text):
            part = pii.region_of(text, low, high)
            got += [(part.tokens[i][0], part.tokens[j - 1][1]) for i, j in part.candidates]
        assert len(got) == len(set(got)) and set(got) == want
        added = [s for low, high in pii.regions(text) for s in model.best(pii.region_of(text, low, high), pii.LEAST_SCORE)]
        assert added == model.best(whole, pii.LEAST_SCORE)
