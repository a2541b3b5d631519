"""Licence notices inside long lines and wrapped over lines."""

from __future__ import annotations

import textwrap

import pytest

from spanvigil.llm import licence_scan

ALL = [(f, t) for f, texts in licence_scan.TEMPLATES.items() for t in texts]


@pytest.fixture(scope="module")
def licences():
    return licence_scan.LicenceModel().learn([b"the red fox and a dog of the house", b"in this way it was to be done", b"version of a file"])


def places(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return [r.places for r in sorted(licence_scan.scan(docs, model=model).collect(), key=lambda r: r.doc_id)]


def test_length_outside_a_notice_does_not_count(spark, licences):
    before = "the red fox and a dog of the house in this way " * 60
    after = " it was to be done by any person" * 60
    got = places(spark, licences, [before + t + after for _, t in ALL])
    assert got == [f"{f}:0" for f, _ in ALL]
    both = before + ALL[0][1] + after + " Licensed under CC BY 4.0. " + before
    assert places(spark, licences, [both, before + after]) == ["CC-BY-4.0:0,MIT:0", ""]


def test_wrapped_notices(spark, licences):
    texts, want = [], []
    for family, template in ALL:
        for width in (30, 60, 78):
            lines = "\n".join(" * " + line for line in textwrap.wrap(template, width))
            texts.append(f"a file of the house\n *\n{lines}\n\nit was to be done")
            texts.append(f"a file of the house\n{lines}\nit was to be done")
            want += [f"{family}:2", f"{family}:1"]
    assert places(spark, licences, texts) == want
    mit = licence_scan.TEMPLATES["MIT"][2].split(" ")
    apart = " ".join(mit[:10]) + "\n\n" + " ".join(mit[10:20]) + "\n\n" + " ".join(mit[20:])
    assert places(spark, licences, [apart]) == [""]
